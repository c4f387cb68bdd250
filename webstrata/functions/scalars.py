"""Text, URL and HTML scalars as SQL of a dialect ``D`` (see ``dialect``). There are three ways to strip markup, on purpose."""

from __future__ import annotations

from webstrata.functions.dialect import SPACES, WIDE

URL_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
URL_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
URL_QUERY = r"^[^?#]*\?([^#]*)"
ANCHOR = r"(?i)<a\s([^>]*?)>([\s\S]*?)</a>"
AREA = r"(?i)<area\s([^>]*?)/?>"
META = r"(?i)<meta\s([^>]*?)/?>"
LINK = r"(?i)<link\s([^>]*?)/?>"
TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"
H1 = r"(?i)<h1[^>]*>([\s\S]*?)</h1>"
H123 = r"(?i)<h[1-3][^>]*>([\s\S]*?)</h[1-3]>"
LD = r"(?i)<script[^>]*type\s*=\s*[\x22\x27]application/ld\+json[\x22\x27][^>]*>([\s\S]*?)</script>"
TRACKING = r"(?i)^(?:utm_\w+|gclid|gclsrc|dclid|fbclid|msclkid|mc_[ce]id|igshid|_hs\w+|vero_\w+|yclid|s_kwcid)$"
IMAGE_URL = r"(?i)\.(?:jpg|jpeg|png|gif|svg|webp|bmp|ico)(?:\.html?)?$|[?&](?-i:img)="
BINARY_URL = r"(?i)\.(?:pdf|zip|gz|tgz|tar|rar|7z|doc|docx|xls|xlsx|ppt|pptx|odt|ods|csv|mp3|mp4|m4a|m4v|avi|mov|wmv|webm|mkv|flv|ogg|wav|exe|dmg|msi|apk|iso|woff2?|ttf|eot)(?:\?|#|$)"
QUESTION = r"(?i)^(?:how|what|why|when|where|who|which|can|do|does|is|are|should)(?:[^A-Za-z0-9_]|$)|\?\s*$"
WAYFINDING = ("here", "read more", "more", "learn more", "click here", "find out more", "back", "home", "next", "previous")
ROBOTS = ("noindex", "nofollow", "noarchive", "nosnippet", "noimageindex", "notranslate")
COPYRIGHT = r"(?i)(?:©|\(c\)|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})"
PRICE = r"[£$€]\s?\d[\d,]*(?:\.\d{2})?"
ORG = r"(?i)Organization|Corporation|LocalBusiness|BankOrCreditUnion"


def squeeze(D, e: str) -> str:
    """Runs of white space to one space, trimmed."""
    if D.__name__ == "Spark":
        return f"trim({D.rep(e, SPACES, ' ')})"
    return D.rep(D.rep(e, f"[{WIDE}]+", " "), "^ | $", "")


def trimmed(D, e: str) -> str:
    return D.rep(e, f"^[{WIDE}]+|[{WIDE}]+$", "")


def inner_text(D, e: str) -> str:
    """Markup of one element to text: tags and &nbsp; to spaces; scripts stay, entities stay."""
    return squeeze(D, D.rep(D.rep(e, "<[^>]*>", " "), "(?i)&nbsp;", " "))


def unscripted(D, e: str) -> str:
    return D.rep(D.rep(D.rep(e, r"(?i)<script[\s\S]*?</script>", " "), r"(?i)<style[\s\S]*?</style>", " "), "<[^>]+>", " ")


def visible_text(D, e: str) -> str:
    """A page's text for comparing facts."""
    return squeeze(D, D.rep(D.rep(unscripted(D, e), "(?i)&nbsp;", " "), "(?i)&amp;", "&"))


def extract_text(D, e: str) -> str:
    """A page's text for extraction: no entity is decoded."""
    return squeeze(D, unscripted(D, e))


def shown(D, text: str) -> str:
    """``visible_text`` from the ``extract_text`` of a page."""
    spaced = D.rep(text, "(?i)&nbsp;", " ")
    decoded = lambda e: D.rep(e, "(?i)&amp;", "&")
    return f"case when not {D.contains(text, chr(39) + '&' + chr(39))} then {text} when {D.like(text, '(?i)&nbsp;')} then {squeeze(D, decoded(spaced))} else {decoded(text)} end"


def host(D, url: str) -> str:
    return f"lower({D.ext(url, URL_HOST)})"


def pathname(D, url: str) -> str:
    """Path of a URL as it stands (``dot_free`` takes dot segments out); '' where it is no URL."""
    return D.ext(url, URL_PATH)


def dot_free(D, path: str) -> str:
    """An absolute path without empty and dot segments, nor a slash at its end; '..' never leads above the root."""
    step = lambda a, x: f"case when {x} in ('', '.') then {a} when {x} = '..' then {D.rep(a, '/[^/]*$', '')} else concat({a}, '/', {x}) end"
    if D.__name__ == "Spark":
        return f"aggregate(split({path}, '/'), '', (a, x) -> {step('a', 'x')})"
    return f"list_reduce(list_prepend('', string_split({path}, '/')), lambda a, x: {step('a', 'x')})"


def page_path(D, url: str) -> str:
    """Where a URL's page is saved below its scan: host and path, one trailing slash less, always .htm(l)."""
    bare = D.rep(pathname(D, url), "/$", "")
    named = f"case when {bare} = '' then '/index.html' when {D.like(bare, '(?i)[.]html?$')} then {bare} else concat({bare}, '.html') end"
    return f"case when {D.like(url, URL_HOST)} then concat({host(D, url)}, {named}) end"


def bare_url(D, url: str) -> str:
    """Without fragment and trailing slashes."""
    return D.rep(D.rep(url, "#.*$", ""), "/+$", "")


def parameter_key(D, p: str) -> str:
    return D.ext(p, "^([^=]*)")


def normal_url(D, url: str) -> str:
    """Fragment and tracking parameters dropped, others sorted by key, trailing slashes dropped but for the root's."""
    kept = D.keep(f"{'split' if D.__name__ == 'Spark' else 'string_split'}({D.ext(url, URL_QUERY)}, '&')", "p", f"p <> '' and not {D.like(parameter_key(D, 'p'), TRACKING)}")
    sort = f"array_sort({D.map(kept, 'p', pair(D))})" if D.__name__ == "Spark" else f"list_sort({D.map(kept, 'p', pair(D))})"
    query = D.join(D.map(sort, "q", "q.p" if D.__name__ == "Spark" else "q.p"), "&")
    path = f"case when {D.rep(pathname(D, url), '/+$', '')} = '' then '/' else {D.rep(pathname(D, url), '/+$', '')} end"
    origin = f"lower({D.ext(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)')})"
    return f"concat({origin}, {path}, case when {query} = '' then '' else concat('?', {query}) end)"


def pair(D) -> str:
    key = parameter_key(D, "p")
    full = f"case when {D.contains('p', chr(39) + '=' + chr(39))} then p else concat(p, '=') end"
    return f"named_struct('k', {key}, 'p', {full})" if D.__name__ == "Spark" else f"{{'k': {key}, 'p': {full}}}"


def href_kind(D, h: str) -> str:
    return f"case when {D.like(h, '(?i)^https?://')} then 'page' when {D.like(h, '(?i)^mailto:')} then 'mailto' when {D.like(h, '(?i)^tel:')} then 'tel' when {D.like(h, '(?i)^javascript:')} then 'script' when {D.like(h, '^#')} then 'fragment' else 'other' end"


def attribute(D, attrs: str, name: str) -> str:
    """A quoted attribute, double quotes first; unanchored, as in markup scanning ``data-x`` counts for ``x``. '' if absent."""
    double = D.ext(attrs, rf"(?i){name}\s*=\s*\x22([^\x22]*)\x22")
    single = D.ext(attrs, rf"(?i){name}\s*=\s*\x27([^\x27]*)\x27")
    return f"case when {D.like(attrs, rf'(?i){name}' + r'\s*=\s*\x22([^\x22]*)\x22')} then {double} else {single} end"


def loose_attribute(D, attrs: str, name: str) -> str:
    """An attribute quoted either way or bare, by its whole name, the last where it is repeated; '' if absent."""
    pattern = rf"(?is)(?:^|.*[^\w:-]){name}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s\x22\x27>]+))"
    return f"concat({', '.join('coalesce(' + D.ext(attrs, pattern, g) + ', ' + chr(39) * 2 + ')' for g in (1, 2, 3))})"


def phone_key(D, e: str) -> str:
    return D.rep(D.rep(e, "[^0-9]", ""), "^44", "0")


def phones(D, text: str) -> str:
    found = D.map(D.every(text, rf"(?:\+44\s?|{D.ZERO})(?:\d[\d\s-]{{8,12}}\d)", 0), "v", trimmed(D, "v"))
    return D.distinct(D.keep(found, "v", f"length({phone_key(D, 'v')}) between 10 and 13"))


def emails(D, text: str) -> str:
    """Only a text with an @ is searched: the pattern starts at every word."""
    edge = D.EDGE
    some = f"case when {D.contains(text, chr(39) + '@' + chr(39))} then {text} else '' end"
    return D.distinct(D.map(D.every(some, rf"{edge}[\w.+-]+@[\w-]+\.[\w.-]{{2,}}{edge}", 0), "v", "lower(v)"))


def postcodes(D, text: str) -> str:
    return D.distinct(D.map(D.every(text, rf"{D.START}[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}}{D.END}", 0), "v", D.rep("upper(v)", r"\s+", " ")))


def prices(D, text: str) -> str:
    return D.distinct(D.map(D.every(text, PRICE, 0), "v", D.rep("v", r"\s+", "")))


def facty(D) -> str:
    return rf"((?:\+44\s?|{D.START}0)\d[\d\s-]{{8,12}}\d|[£$€]\s?\d[\d,]*(?:\.\d{{2}})?|{D.START}[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}}{D.END})"


def js_round(e: str) -> str:
    """Half up, also below zero."""
    return f"floor(({e}) + 0.5)"
