"""URL functions on columns: host, rating, private hosts, kinds of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sites and top-level domains by what they mean for a link.
KNOWN_SITES = ("google.com", "youtube.com", "microsoft.com", "apple.com", "amazon.com", "wikipedia.org", "cloudflare.com", "mozilla.org", "adobe.com", "linkedin.com", "office.com", "live.com", "bing.com", "duckduckgo.com", "stackoverflow.com", "who.int", "nih.gov")
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "sourceforge.net", "npmjs.com", "pypi.org", "nuget.org", "hub.docker.com", "codeberg.org", "gist.github.com")
FILE_HOSTS = ("dropbox.com", "drive.google.com", "mega.nz", "mediafire.com", "wetransfer.com", "onedrive.live.com", "box.com", "anonfiles.com", "gofile.io", "sendspace.com")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rb.gy")
RISKY_ENDINGS = (".zip", ".mov", ".xyz", ".top", ".tk", ".gq", ".ml", ".cf", ".ga", ".work", ".click")
UNSAFE_SCHEMES = ("javascript:", "file:", "data:")
#: Fixed names of hosts that are not public; the empty one too.
PRIVATE_NAMES = ("", "localhost", "0.0.0.0", "::1")
#: Fixed ranges of addresses that are not public: the first number, and the second from and to, if it matters.
PRIVATE_RANGES = ((10, None, None), (127, None, None), (169, 254, 254), (172, 16, 31), (192, 168, 168))
#: The first 16 bits of local addresses of the newer kind.
LOCAL_FIRST, LOCAL_LAST = 0xFC00, 0xFDFF


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def host_of(url: Column) -> Column:
    """The host in lower case, or null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\s]+)(?::[0-9]*)?(?:[/?#].*)?$", 1)
    return F.when(found != "", F.lower(found))


def within(host: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or lies under it."""
    return _any([(host == d) | host.endswith(f".{d}") for d in domains])


def rating(url: Column) -> Column:
    """struct<level, category>: the first rule that holds."""
    host, low = host_of(url), F.lower(url)
    pair = lambda level, category: F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"))
    return (
        F.when(_any([low.startswith(s) for s in UNSAFE_SCHEMES]), pair("red", "unsafe-scheme"))
        .when(host.isNull(), pair("yellow", "unparseable"))
        .when(_any([host.endswith(e) for e in RISKY_ENDINGS]), pair("red", "risky-tld"))
        .when(within(host, SHORTENERS), pair("yellow", "url-shortener"))
        .when(within(host, CODE_HOSTS), pair("yellow", "code-hosting"))
        .when(within(host, FILE_HOSTS), pair("yellow", "file-hosting"))
        .when(host.endswith(".gov") | host.endswith(".edu") | within(host, KNOWN_SITES), pair("green", "known-site"))
        .otherwise(pair("yellow", "unknown"))
    )


def is_private(host: Column) -> Column:
    """The host is a name of this machine or an address of a range that is not public."""
    low = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^\[|\]$", "")
    labels = F.split(low, r"\.")
    number = lambda i: F.try_element_at(labels, F.lit(i)).try_cast("int")
    ranges = [(number(1) == a) & (F.size(labels) > 1 if b is None else number(2).between(b, c) & (F.size(labels) > 2)) for a, b, c in PRIVATE_RANGES]
    first = F.regexp_extract(low, "^([0-9a-f]{4}):", 1)
    local = (first != "") & F.conv(first, 16, 10).cast("int").between(LOCAL_FIRST, LOCAL_LAST)
    return F.coalesce(low.isin(*PRIVATE_NAMES) | local | _any([F.coalesce(r, F.lit(False)) for r in ranges]), F.lit(False))


def is_pdf_url(url: Column) -> Column:
    """An http, https or file URL of a public host whose path ends in .pdf."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return scheme.isin("http", "https", "file") & ((scheme == "file") | ~is_private(host_of(url))) & F.lower(path).endswith(".pdf")


def file_kind(name: Column) -> Column:
    """pdf, image or docx by the end of a file's name; pdf if in doubt."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.(png|jpe?g|gif|bmp|webp|tiff?)$"), "image").when(low.rlike(r"\.docx?$"), "docx").otherwise("pdf")


#: Fixed names of link actions and the kinds they make.
ACTION_KINDS = {"URI": "uri", "JavaScript": "javascript", "GoTo": "goto", "GoToR": "remote-goto", "Launch": "launch", "Named": "named", "SubmitForm": "submit"}


def link_kind(action: Column, has_destination: Column) -> Column:
    """What a link does: by its action; any other action is a link; without action, goto if it has a destination."""
    kinds = F.create_map(*[F.lit(x) for pair in ACTION_KINDS.items() for x in pair])
    return F.when(action.isNotNull(), F.coalesce(F.try_element_at(kinds, action), F.lit("link"))).when(has_destination, "goto").otherwise("link")


def is_vendor_context(url: Column, domain: str = "adobe.com") -> Column:
    """The URL's host is the domain or lies under it."""
    return F.coalesce(within(host_of(url), (domain,)), F.lit(False))
