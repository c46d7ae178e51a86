"""URL functions on columns: canonical form, fingerprint, host, links made absolute."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_url(url: Column | str) -> Column:
    """The url without its fragment, its raw query parts in order.

    Parts are compared as they are written and never decoded; a url without a query only
    loses its fragment.  Null stays null.
    """
    bare = F.substring_index(_col(url), "#", 1)
    at = F.locate("?", bare)
    parts = F.array_sort(F.split(F.substr(bare, at + 1), "&", -1))
    return F.when(at > 0, F.concat(F.substr(bare, F.lit(1), at), F.array_join(parts, "&"))).otherwise(bare)


def fingerprint(url: Column | str, method: Column | str = "GET") -> Column:
    """SHA-1 (hexadecimal) of the canonical url and the method; bodies and headers don't count. A plain string is the method itself."""
    return F.sha1(F.concat(canonical_url(url), F.lit(method) if isinstance(method, str) else method))


def host(url: Column | str) -> Column:
    """Host of a url, null where it has none or can't be parsed."""
    return F.try_parse_url(_col(url), F.lit("HOST"))


def origin(url: Column | str) -> Column:
    """Scheme and host, as written, of a url with both; otherwise an empty string."""
    return F.regexp_extract(_col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


#: Links that stay as they are.
SKIPPED_PREFIXES = ("#", "javascript:", "mailto:")


@F.pandas_udf(StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, a: str | None) -> str | None:
        if a is None or b is None:
            return None
        try:
            return urljoin(b, a)
        except ValueError:
            return None

    return pd.Series([one(b, a) for b, a in zip(base, link, strict=True)], dtype=object)


def absolute_url(base: Column | str, link: Column | str) -> Column:
    """The link seen from base.

    Links with a scheme and plain paths from the root are joined in the JVM; other forms
    (relative paths, dots, queries alone) go through one Arrow function.
    """
    base, link = _col(base), _col(link)
    has_scheme = link.rlike(r"^https?://[^/?#\[\]\s;]+(/[^?#\s;]*)?([?#][^\s;]*)?\z") & ~link.rlike(r"/\.\.?(/|\?|#|$)|[?#]$|\?#")
    from_root = link.rlike(r"^/(?!/)[A-Za-z0-9_~%,!$&'()*+=:@.\-/]*\z") & ~link.rlike(r"/\.\.?(/|$)") & base.rlike(r"^https?://[^/?#\[\]\s;]+([/?#]|$)")
    slow = ~F.coalesce(has_scheme, F.lit(False)) & ~F.coalesce(from_root, F.lit(False))
    return F.when(F.coalesce(has_scheme, F.lit(False)), link).when(F.coalesce(from_root, F.lit(False)), F.concat(origin(base), link)).otherwise(_joined(F.when(slow, base), F.when(slow, link)))


_ATTRIBUTE, _QUOTE = re.compile(r"""(?:src|href)=["']"""), re.compile("[\"']")


def with_absolute_links(text: str, base: str) -> str:
    """Rewrite the first quoted src or href of each tag, up to the tag's end, to an absolute url.

    The text is gone through once, where the expression itself would start anew at each tag.
    """
    out, done, at = [], 0, text.find("<")
    while at >= 0 and (name := _ATTRIBUTE.search(text, at + 1)) and (quote := _QUOTE.search(text, name.end())):
        end = text.find(">", quote.end())
        if end < 0:
            break
        link = text[name.end() : quote.start()]
        if link and not link.startswith(SKIPPED_PREFIXES):
            out += [text[done : name.end()], urljoin(base, link)]
            done = quote.start()
        at = text.find("<", end + 1)
    return "".join([*out, text[done:]])


@F.pandas_udf(StringType())
def make_links_absolute(text: pd.Series, base: pd.Series) -> pd.Series:
    """Text whose links are absolute; null text stays null, and with a null base nothing changes."""
    return pd.Series([t if t is None or b is None else with_absolute_links(t, b) for t, b in zip(text, base, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def decode_leniently(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes as text; where the encoding doesn't fit, bad bytes are left out."""

    def one(b: bytes | None, e: str | None) -> str | None:
        if b is None:
            return None
        b = bytes(b)
        try:
            return b.decode(e or "utf-8")
        except (UnicodeDecodeError, LookupError):
            try:
                return b.decode(e or "utf-8", "ignore")
            except LookupError:
                return b.decode("utf-8", "ignore")

    return pd.Series([one(b, e) for b, e in zip(body, encoding, strict=True)], dtype=object)


#: A link in html as the native extraction sees it.
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def hrefs(html: Column | str) -> Column:
    """All quoted href values of <a> tags, in order, found in the JVM."""
    return F.regexp_extract_all(_col(html), F.lit(HREF), F.lit(1))

