"""Text normalisation and extraction as Column expressions (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


#: characters that count as blank at the ends of a text
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def bind(col: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def _replace_if(col: Column, guard, pattern: str, by: str) -> Column:
    """regexp_replace behind a cheap necessary condition: most texts skip the costly search."""
    return bind(col, lambda v: F.when(guard(v), F.regexp_replace(v, pattern, by)).otherwise(v))


def _not_ascii(v: Column) -> Column:
    return F.octet_length(v) != F.char_length(v)


def normalize_name(col: Column) -> Column:
    """Canonical product name: drop trailing bracket groups, halve wide characters, fix `Ti` and `GB`."""
    c = strip(F.coalesce(col, F.lit("")))
    c = _replace_if(c, lambda v: F.endswith(v, F.lit(")")) | F.endswith(v, F.lit("）")), r"(?U)(?:[（(][^（）()]*[)）]\s*)+$", "")
    c = bind(strip(c), lambda v: F.when(_not_ascii(v), F.translate(v, _WIDE, _NARROW)).otherwise(v))
    c = _replace_if(c, lambda v: _not_ascii(v) | any_word(v, ("  ", "\t", "\n", "\r", "\x0b", "\x0c")), r"(?U)\s+", " ")
    c = _replace_if(c, lambda v: F.contains(F.lower(v), F.lit("ti")), r"(?iU)(?:(?<=\d) ?| )ti\b", " Ti")
    c = _replace_if(c, lambda v: _not_ascii(v) | any_word(F.translate(v, "123456789G", "000000000g"), ("0g", "0 g")), r"(?U)(\d)\s*[Gg]\b", "$1GB")
    return strip(c)


def norm_token(col: Column) -> Column:
    """Title/spec token form: lower case, no blanks, `gb` as `g`, multiplication signs as `x`."""
    c = F.replace(F.lower(F.coalesce(col, F.lit(""))), F.lit(" "), F.lit(""))
    return F.translate(F.replace(c, F.lit("gb"), F.lit("g")), "×*", "xx")


def norm_title(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"(?U)\s+", "")


def parse_price(col: Column, on_error: str = "zero") -> Column:
    """Digits and dots of a price text; unparsable text gives 0, or +inf for sorting last."""
    bad = F.lit(0.0) if on_error == "zero" else F.lit(float("inf"))
    return F.coalesce(F.regexp_replace(col.cast("string"), "[^0-9.]", "").try_cast("double"), bad)


def first_keyword(col: Column, words, default: str | None) -> Column:
    out = F.lit(default)
    for word in reversed(words):
        out = F.when(F.contains(col, F.lit(word)), F.lit(word)).otherwise(out)
    return out


def promo_event(col: Column) -> Column:
    return first_keyword(F.coalesce(col, F.lit("")), fixed.PROMO_EVENTS, fixed.NO_PROMO)


def channel_of(col: Column) -> Column:
    c = F.coalesce(col, F.lit(""))
    return (F.when(c.contains("自营"), "自营").when(c.contains("旗舰"), "官旗").otherwise("三方店铺"))


def brand_of(col: Column, vocab, mode: str = "first", skip=("公版",)) -> Column:
    """Brand word in a text: `first` follows vocabulary order, `longest` takes the longest hit."""
    words = [w for w in vocab if w and w not in (skip if mode == "first" else ())]
    if mode == "longest":
        words = sorted(words, key=len, reverse=True)
    return first_keyword(F.coalesce(col, F.lit("")), words, "")


def estimate_tokens(col: Column) -> Column:
    """One token per CJK character plus a quarter token per other character, rounded up."""
    c = F.coalesce(col, F.lit(""))
    rest = F.length(F.regexp_replace(c, r"[\u4e00-\u9fff\u3000-\u303f]", ""))
    return (F.length(c) - rest + F.ceil(rest / 4)).cast("long")


def _pii_guard(kind: str, c: Column) -> Column:
    """Cheap necessary condition of a pattern, so that most texts skip the costly search."""
    if kind == "email":
        return F.contains(c, F.lit("@"))
    if kind == "api_key":
        return F.rlike(c, F.lit("[:=]"))
    return F.rlike(c, F.lit("(?U)\\d{11}"))


def pii_flags(col: Column) -> Column:
    """Array of the kinds of personal data or secrets found, in fixed order."""
    c = F.coalesce(col, F.lit(""))
    return F.array_compact(F.array(*[F.when(_pii_guard(k, c) & F.rlike(c, F.lit(p)), F.lit(k)) for k, p in fixed.PII.items()]))


def privacy_class(flags: Column, declared: Column) -> Column:
    return (F.when((declared == "secret") | (F.size(flags) > 0), "secret")
            .when(declared == "internal", "internal").otherwise("public"))


def redact(col: Column, limit: int = 2000) -> Column:
    c = F.coalesce(col, F.lit(""))
    for kind, pattern in fixed.PII.items():
        c = _replace_if(c, lambda v, kind=kind: _pii_guard(kind, v), pattern, "[REDACTED]")
    return F.substring(c, 1, limit)


def clean_zero_width(col: Column) -> Column:
    return F.regexp_replace(col, r"[\u200b-\u200f\ufeff\u2060]", "")


def question_keywords(col: Column) -> Column:
    c = F.regexp_replace(F.coalesce(col, F.lit("")), fixed.QUESTION_PREFIX, "")
    c = F.regexp_replace(c, fixed.QUESTION_TAIL, "")
    tokens = F.regexp_extract_all(c, F.lit(f"({fixed.QUESTION_TOKEN})"), 1)

    def trim(t: Column) -> Column:
        t = F.regexp_replace(t, fixed.QUESTION_LEAD, "")
        return F.regexp_replace(t, fixed.QUESTION_TRAIL, "")

    return F.array_distinct(F.filter(F.transform(tokens, trim),
                                     lambda t: (F.length(t) >= 2) & ~t.isin(*fixed.QUESTION_STOP)))


def extract_prices(col: Column) -> Column:
    """Price-like strings of a text, distinct in first-seen order."""
    hits = F.regexp_extract_all(col, F.lit(f"(?U)({fixed.PRICE_TEXT})"), 1)
    return F.array_distinct(F.transform(hits, strip))


def content_hash(*cols: Column) -> Column:
    """sha256 over named fields in sorted name order; cast inputs so that equal values hash equally."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def spec_hash(df_cols: dict[str, Column]) -> Column:
    return content_hash(*[df_cols[k].alias(k) for k in sorted(df_cols)])


def question_hash(col: Column) -> Column:
    return F.sha2(strip(col), 256)


def question_id(col: Column) -> Column:
    return F.substring(question_hash(col), 1, 16)


def any_word(col: Column, words) -> Column:
    """True when the text holds any of the words (plain containment, no regex)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(col, F.lit(w))
    return hit
