"""Scalar SQL for two engines: Spark runs the operators, DuckDB the checks against them.

Patterns keep to what Java and RE2 read alike; quotes are written \\x22 and \\x27, and the one real difference, the
ASCII word boundary, is a constant of the dialect (Java's own also counts accented letters).
"""

from __future__ import annotations

#: White space as browsers see it, wider than ASCII.
WIDE = r"\s\x0B\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

#: The same for Java: most characters are told from white space by a table or by being Latin, not by all of the class.
SPACES = r"(?:[\t\n\x0B\f\r \x{00a0}]|(?![\x{00}-\x{ff}])[" + WIDE + "])[" + WIDE + "]*"


class Spark:
    #: A word boundary before a word character, and one after it: cheaper than ``EDGE``, which looks both ways.
    START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    #: A zero at the start of a word: most characters are told from it without looking back.
    ZERO = "0(?<![A-Za-z0-9_]0)"
    EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

    @staticmethod
    def rep(e: str, pattern: str, by: str) -> str:
        return f"regexp_replace({e}, r'{pattern}', '{by}')"

    @staticmethod
    def ext(e: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({e}, r'{pattern}', {group})"

    @staticmethod
    def every(e: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({e}, r'{pattern}', {group})"

    @staticmethod
    def like(e: str, pattern: str) -> str:
        return f"({e} rlike r'{pattern}')"

    @staticmethod
    def map(array: str, x: str, body: str) -> str:
        return f"transform({array}, {x} -> {body})"

    @staticmethod
    def keep(array: str, x: str, body: str) -> str:
        return f"filter({array}, {x} -> {body})"

    @staticmethod
    def first(array: str) -> str:
        return f"get({array}, 0)"

    @staticmethod
    def distinct(array: str) -> str:
        return f"array_sort(array_distinct({array}))"

    @staticmethod
    def size(array: str) -> str:
        return f"cast(size({array}) as bigint)"

    @staticmethod
    def join(array: str, by: str) -> str:
        return f"array_join({array}, '{by}')"

    @staticmethod
    def contains(e: str, part: str) -> str:
        return f"contains({e}, {part})"


class Duck:
    START = END = EDGE = r"\b"
    ZERO = r"\b0"

    @staticmethod
    def rep(e: str, pattern: str, by: str) -> str:
        return f"regexp_replace({e}, '{pattern}', '{by}', 'g')"

    @staticmethod
    def ext(e: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({e}, '{pattern}', {group})"

    @staticmethod
    def every(e: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({e}, '{pattern}', {group})"

    @staticmethod
    def like(e: str, pattern: str) -> str:
        return f"regexp_matches({e}, '{pattern}')"

    @staticmethod
    def map(array: str, x: str, body: str) -> str:
        return f"list_transform({array}, lambda {x}: {body})"

    @staticmethod
    def keep(array: str, x: str, body: str) -> str:
        return f"list_filter({array}, lambda {x}: {body})"

    @staticmethod
    def first(array: str) -> str:
        return f"({array})[1]"

    @staticmethod
    def distinct(array: str) -> str:
        return f"list_sort(list_distinct({array}))"

    @staticmethod
    def size(array: str) -> str:
        return f"cast(len({array}) as bigint)"

    @staticmethod
    def join(array: str, by: str) -> str:
        return f"array_to_string({array}, '{by}')"

    @staticmethod
    def contains(e: str, part: str) -> str:
        return f"contains({e}, {part})"
