"""String and number functions as Column expressions (STR-*, NUM-*, DT-1, JSN-*); all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# OCR substitutions, applied in this order.
OCR_SUBSTITUTIONS = (
    ("पाललका", "पालिका"),
    ("पाललिका", "पालिका"),
    ("गाउँपाललका", "गाउँपालिका"),
    ("नगरपाललका", "नगरपालिका"),
    ("ूयोदय", "सूर्योदय"),
    ("री ", ""),
    ("अिु ान", "अनुसन्"),
    ("ल द", "सि"),
    ("ल री", "सिरी"),
    ("लम", "मि"),
    ("फा", "फा"),
    ("रािगढ", "राजगढ"),
    ("ुरुङ्गा", "सुरुङ्गा"),
    ("दुहवी", "दुहबी"),
    ("न्द्द", "नन्द"),
    ("चैन", "चैनपुर"),
    ("अथराई", "आठराई"),
    ("वब", "बि"),
    ("वफ", "फि"),
    ("वह", "हि"),
    ("कु", "कु"),
    ("तुव", "तुम्"),
    ("फाले", "फाले"),
    ("फाल्गु", "फाल्गुनन्"),
    ("बबअथी", "बिबाथी"),
    ("याङवरक", "याङ्वरक"),
    ("मेरर", "मेरि"),
    ("कचन", "कञ्चन"),
    ("न्द्का", "सन्द"),
    ("पाथी", "पाथि"),
    ("रोरा", "रोराङ"),
)
ARABIC, DEVANAGARI = "0123456789", "०१२३४५६७८९"
#: Tokens that stand for no number.
CENSUS_BLANK = ("", "..", "...", "-", "NA", "N/A")
AMOUNT_BLANK = ("", "-", "—", "N/A", "n/a")


def normalize_devanagari(c: Column) -> Column:
    """STR-1: the ordered substitutions; not idempotent, as the order lets one feed the next."""
    for wrong, right in OCR_SUBSTITUTIONS:
        if wrong != right:
            c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def is_devanagari_dominant(c: Column) -> Column:
    """STR-2: over half of the characters that aren't space are Devanagari, digits apart."""
    bare = F.regexp_replace(c, r"(?U)\s", "")
    own = F.regexp_replace(bare, "[^ऀ-॥॰-ॿ]", "")
    return F.coalesce(F.length(own) * 2 > F.length(bare), F.lit(False))


def numeral_script(c: Column) -> Column:
    """STR-3: devanagari, arabic, mixed or none."""
    d, a = c.rlike("[०-९]"), c.rlike("[0-9]")
    return F.when(d & a, "mixed").when(d, "devanagari").when(a, "arabic").otherwise("none")


def to_arabic(c: Column) -> Column:
    """STR-4."""
    return F.translate(c, DEVANAGARI, ARABIC)


def to_devanagari(c: Column) -> Column:
    """STR-4."""
    return F.translate(c, ARABIC, DEVANAGARI)


def both_numerals(c: Column) -> Column:
    """STR-5: struct(text without digits, arabic, devanagari); the numbers are null where there is no digit."""
    n = normalize_devanagari(c)
    digits = to_arabic(F.regexp_replace(n, "[^0-9०-९]", ""))
    some = digits != ""
    text = F.trim(F.regexp_replace(F.regexp_replace(n, "[0-9०-९]", ""), r"(?U)\s+", " "))
    return F.struct(text.alias("text"), F.when(some, digits).alias("arabic"), F.when(some, to_devanagari(digits)).alias("devanagari"))


def slugify(*parts: Column) -> Column:
    """STR-6."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def claim_slug(indicator: Column, fiscal_year: Column, period_type: Column) -> Column:
    """STR-7."""
    return F.lower(F.concat_ws("-", indicator, F.replace(fiscal_year, F.lit("/"), F.lit("-")), F.replace(period_type, F.lit("_"), F.lit("-"))))


def squash(c: Column) -> Column:
    """STR-8."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def file_name(c: Column) -> Column:
    """STR-9: sanitised name; null if nothing but underscores is left."""
    s = F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    return F.when(~s.rlike("^_*$"), s)


def is_source_id(c: Column) -> Column:
    """STR-10: three or more of a-z, 0-9 and hyphen, not starting with a hyphen."""
    return c.rlike("^[a-z0-9-]{3,}$") & ~c.startswith("-")


def is_iso_timestamp(c: Column) -> Column:
    """STR-10: starts as an ISO timestamp does, up to its T."""
    return F.substring(c, 1, 11).rlike("^[0-9]{4}(?:-[0-9]{2}){2}T$")


def page_urls(url: Column, cap: int) -> Column:
    """STR-11: the first page is the url itself, later ones carry ``page=``."""
    sep = F.when(F.contains(url, F.lit("?")), "&page=").otherwise("?page=")
    return F.transform(F.sequence(F.lit(1), F.lit(cap)), lambda n: F.when(n == 1, url).otherwise(F.concat(url, sep, n.cast("string"))))


#: Scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B), with their marks.
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(path: Column) -> Column:
    """A path without its dot segments: a stack of segments, which two dots take the last from and one dot leaves as it is."""
    parts = F.split(path, "/", -1)
    rooted, last = path.startswith("/"), F.element_at(parts, -1)
    none = F.expr("cast(array() as array<string>)")
    steps = F.filter(F.slice(parts, F.when(rooted, F.lit(2)).otherwise(F.lit(1)), F.size(parts)), lambda s: s != ".")
    stack = F.aggregate(steps, none, lambda acc, s: F.when(s != "..", F.array_append(acc, s)).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))))
    # A dot segment at the end leaves its slash.
    stack = F.when(last.isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)
    return F.when(F.contains(path, F.lit(".")), F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))).otherwise(path)


def absolute_url(base: Column, href: Column) -> Column:
    """STR-12: a reference resolved against a base (RFC 3986, section 5.2); one with the base's own scheme and no authority is relative, as of old; one with a host of its own stays as it is."""
    part = lambda c, i: F.regexp_extract(c, _PARTS, i)
    own = F.lower(part(base, 1))
    ref = F.when((part(href, 1) != "") & (F.lower(part(href, 1)) == own) & (part(href, 2) == ""), F.substring(href, F.length(part(href, 1)) + 1, F.length(href))).otherwise(href)
    scheme, host, path, query, mark = (part(ref, i) for i in range(1, 6))
    b_host, b_path = part(base, 2), part(base, 3)
    merged = F.when((b_host != "") & (b_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(b_path, "(?s)^(.*/)[^/]*$", 1), path))
    beside = F.when(path.startswith("/"), without_dots(path)).otherwise(without_dots(merged))
    relative = F.when(path == "", F.concat(b_host, b_path, F.when(query != "", query).otherwise(part(base, 4)))).otherwise(F.concat(b_host, beside, query))
    return F.when(scheme != "", ref).otherwise(F.concat(part(base, 1), F.when(host != "", F.concat(host, path, query)).otherwise(relative), mark))


def category_id(url: Column) -> Column:
    """STR-13."""
    return F.regexp_extract(url, "/category/([0-9]+)", 1)


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inner_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, "<[^>]*>", " ")), r"(?U)\s+", " "))


def category_name(html: Column) -> Column:
    """STR-14: first that isn't empty of the first heading, the page title class, the title."""
    found = [inner_text(F.regexp_extract(html, p, 1)) for p in (r"(?is)<h1[^>]*>(.*?)</h1>", r'(?is)<[^>]*class="[^"]*page-title[^"]*"[^>]*>(.*?)</', r"(?is)<title[^>]*>(.*?)</title>")]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), F.lit(""))


def is_pdf(href: Column) -> Column:
    """FLT-7."""
    return F.lower(F.split_part(href, F.lit("?"), F.lit(1))).endswith(".pdf")


def is_provisional(c: Column) -> Column:
    """STR-17."""
    return c.rlike("(?i)preliminary|provisional")


#: Longest string whose matches fit the bits of a bigint.
LCS_BITS = 62


def _lcs_bits(a: Column, b: Column) -> Column:
    """Longest common subsequence of strings of which ``a`` has ``LCS_BITS`` characters at most.

    Bit i of a state is 0 where the row of the table steps up at character i of ``a``; one addition carries a whole row.
    """
    letters = F.split(a, "")
    places = lambda ch: F.aggregate(F.sequence(F.lit(0), F.length(a) - 1), F.lit(0).cast("bigint"), lambda m, i: F.when(F.get(letters, i) == ch, m + F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(m))
    distinct = F.array_distinct(letters)
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(a)) - 1
    # Bound once by ``transform``, so that the masks aren't computed again for each character of b.
    own = F.array(F.struct(F.map_from_arrays(distinct, F.transform(distinct, places)).alias("masks"), full.alias("full")))

    def run(o):
        def step(v, ch):
            hit = v.bitwiseAND(F.coalesce(F.try_element_at(o["masks"], ch), F.lit(0).cast("bigint")))
            return (v + hit).bitwiseOR(v - hit).bitwiseAND(o["full"])

        return F.aggregate(F.split(b, ""), o["full"], step)

    return F.length(a) - F.bit_count(F.element_at(F.transform(own, run), 1))


def _lcs_rows(a: Column, b: Column) -> Column:
    """The same for strings of any length, a row of the table at a time."""
    letters = F.split(a, "")
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(prev, ch):
        def cell(acc, j):
            up, diagonal, left = F.get(prev, j), F.get(prev, j - 1), F.element_at(acc, -1)
            return F.array_append(acc, F.when(b.substr(j, F.lit(1)) == ch, diagonal + 1).otherwise(F.greatest(up, left)))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(letters, first, row), -1)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    n, m = F.length(a), F.length(b)
    return F.when((n == 0) | (m == 0), F.lit(0)).when(n <= LCS_BITS, _lcs_bits(a, b)).when(m <= LCS_BITS, _lcs_bits(b, a)).otherwise(_lcs_rows(a, b))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """STR-18: 200 * LCS / (|a| + |b|); 100 for two empty strings."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / n)


#: What Python reads as a float: digits may be parted by underscores, which ``_float`` takes out before.
_FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: What JavaScript reads as a number.
_NUMBER = r"^(?:[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"


def _float(c: Column) -> Column:
    """A trimmed string as a double, digits of both scripts; null where its shape isn't a number's. The engine's cast alone would take ``5d`` and ``3f``."""
    t = F.regexp_replace(to_arabic(F.trim(c)), "(?<=[0-9])_(?=[0-9])", "")
    return F.when(t.rlike(_FLOAT), t.try_cast("double"))


def census_number(c: Column) -> Column:
    """NUM-1."""
    return F.when(~F.trim(c).isin(*CENSUS_BLANK), _float(c))


def amount(c: Column) -> Column:
    """NUM-2."""
    t = F.trim(F.replace(c, F.lit(","), F.lit("")))
    return F.when(~t.isin(*AMOUNT_BLANK), t.try_cast("decimal(20,2)"))


def plain_number(c: Column) -> Column:
    """NUM-3: NaN is no number."""
    v = _float(c)
    return F.when(~F.isnan(v), v)


def is_finite(c: Column) -> Column:
    """NUM-4: a number that is neither infinite nor NaN; strings by their shape, and blank ones are none."""
    s = c.cast("string")
    return F.coalesce(F.trim(s).rlike(_NUMBER) & (F.contains(F.lower(s), F.lit("x")) | F.contains(F.lower(s), F.lit("o")) | F.contains(F.lower(s), F.lit("b")) | (F.abs(F.trim(s).try_cast("double")) != float("inf"))), F.lit(False))


def display_number(c: Column) -> Column:
    """NUM-5: grouped, two decimals at most, halves away from zero, no trailing zeros."""
    v = F.round(c.cast("decimal(30,10)"), 2).cast("decimal(22,2)")
    return F.regexp_replace(F.regexp_replace(F.format_number(v, 2), "0+$", ""), r"\.$", "")


def federal_code(c: Column) -> Column:
    """NUM-6: eight digits; null for what is no whole number or longer."""
    v = c.try_cast("bigint")
    return F.when((v >= 0) & (v < 100_000_000), F.lpad(v.cast("string"), 8, "0"))


def listing_date(c: Column) -> Column:
    """DT-1: the first ISO date, else year/month/day; an impossible ISO date is null without a second try."""
    iso = F.regexp_extract(c, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    slash = F.regexp_extract(c, r"([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})", 1)
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(slash != "", F.try_to_date(slash, "yyyy/M/d"))
