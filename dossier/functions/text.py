"""Text columns: tokens, normal forms, overlaps, fingerprints, sentences."""
from __future__ import annotations

import html as _html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed value: a token is a Hangul run or a Latin/digit run.
TOKEN_RE = "([가-힣]+|[a-zA-Z0-9_]+)"
SPACES = " \t\n\r\f\u000b"


def let(value: Column, body) -> Column:
    """Bind an expression once; a lambda that names it would evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def tokenize(c: Column, unicode_letters: bool = False) -> Column:
    """Hangul runs and lower-cased Latin/digit runs; other letters split a token.

    ``unicode_letters`` is the profile for accented languages.
    """
    if unicode_letters:
        return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.regexp_extract_all(ascii_lower(c), F.lit(TOKEN_RE), F.lit(1))


_TOKENS = re.compile(TOKEN_RE)


def tokens_of(s: str) -> list[str]:
    """What ``tokenize`` gives, in Python. Two letters beyond ASCII have ASCII ones in their lower case."""
    if "\u0130" in s or "\u212a" in s:
        return [t.lower() for t in _TOKENS.findall(s)]
    return _TOKENS.findall(s.lower())


def token_set(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


def ngrams_of(c: Column, n: int = 2) -> Column:
    """All n-character windows of a string, in order (empty when shorter)."""
    return let(c, lambda s: F.when(F.length(s) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))),
        lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def bigram_tokens(c: Column) -> Column:
    """Latin runs as they are; a Hangul run gives its character pairs and itself."""
    toks = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+|[가-힣]+)"), F.lit(1))
    return F.flatten(F.transform(toks, lambda t: F.when(
        t.rlike("^[가-힣]"), F.concat(ngrams_of(t, 2), F.array(t))).otherwise(F.array(t))))


def char_ngrams(c: Column, n: int = 2, hangul_only: bool = False) -> Column:
    """Distinct n-grams of the text without whitespace; shorter text is its own gram."""
    bare = F.regexp_replace(c, r"[^가-힣]+" if hangul_only else r"\s+", "")
    return let(bare, lambda b: F.when(F.length(b) == 0, F.array().cast("array<string>")).when(
        F.length(b) < n, F.array(b)).otherwise(F.array_distinct(ngrams_of(b, n))))


def containment(a: Column, b: Column) -> Column:
    """|A n B| / |A| of two arrays of distinct items; 0 when a side is empty."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.lit(1), F.size(s["a"]))))


def overlap_from_counts(common: Column, q_distinct: Column, c_distinct: Column) -> Column:
    """0.75 * query coverage + 0.25 * density; 0 when a side has no token."""
    return F.when((q_distinct == 0) | (c_distinct == 0), F.lit(0.0)).otherwise(
        0.75 * common / q_distinct
        + 0.25 * common / F.greatest(F.lit(10.0), F.sqrt(c_distinct.cast("double"))))


def overlap_score(q: Column, c: Column) -> Column:
    return let(F.struct(token_set(q).alias("q"), token_set(c).alias("c")), lambda s: overlap_from_counts(
        F.size(F.array_intersect(s["q"], s["c"])), F.size(s["q"]), F.size(s["c"])))


def qc_overlap(a: Column, b: Column) -> Column:
    """Token containment; without tokens bigrams; then a long common string."""
    ta, tb = token_set(a), token_set(b)
    ga, gb = char_ngrams(a), char_ngrams(b)
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), containment(ta, tb)).when(
        (F.size(ga) > 0) & (F.size(gb) > 0), containment(ga, gb)).when(
        (F.length(a) >= 8) & (b.contains(a) | a.contains(b)), F.lit(1.0)).otherwise(F.lit(0.0))


def long_words(c: Column, min_len: int = 4) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]{%d,})" % min_len), F.lit(1))


def long_word_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(long_words(a)), F.array_distinct(long_words(b))))


def norm_ws(c: Column, lower: bool = False) -> Column:
    out = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.lower(out) if lower else out


# UTF-8 read as Latin-1, in the order they are put right.
MOJIBAKE = [
    ("â€¢", "•"), ("â€˜", "'"), ("â€™", "'"),
    ("â€œ", '"'), ("â€\u009d", '"'), ("â€”", "—"),
    ("â€“", "–"), ("Â·", "·"), ("Â ", " "), ("Â", ""),
]
# Entities replaced without leaving the JVM.
NAMED_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                  ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
# Fixed value: markup left over in extracted text.
RESIDUE_RE = r"(?is)<!--.*?-->|</?(?:image|table|tr|td|th|div|span|p|br)\b[^>]*>"


def unescape_named(c: Column) -> Column:
    for name, char in NAMED_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def unescape_all(c: Column) -> Column:
    """Every HTML entity; only texts that hold an ampersand go to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


@F.arrow_udf(StringType())
def _unescape(s: pa.Array) -> pa.Array:
    return unescaped(s)


def unescaped(s: pa.Array, rows: int = 128) -> pa.Array:
    """Texts without entities; ``rows`` of them are Python strings at a time, and those without an ampersand never are."""
    parts = []
    for at in range(0, len(s), rows):
        part = s.slice(at, rows)
        has = pc.fill_null(pc.match_substring(part, "&"), False)
        if pc.any(has).as_py():
            part = pc.replace_with_mask(part, has, pa.array([_html.unescape(v) for v in part.filter(has).to_pylist()], part.type))
        parts.append(part)
    return pa.concat_arrays(parts) if parts else s


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v) if v is not None else None)


def normalize_corpus_text(c: Column, full_entities: bool = False) -> Column:
    t = F.coalesce(c, F.lit(""))
    for bad, good in MOJIBAKE:
        t = F.replace(t, F.lit(bad), F.lit(good))
    t = unescape_all(t) if full_entities else unescape_named(t)
    t = F.regexp_replace(t, RESIDUE_RE, " ")
    t = F.regexp_replace(t, r"\|{2,}", " | ")
    t = F.regexp_replace(t, r"-{5,}", " ")
    return strip(F.regexp_replace(t, r"\s+", " "))


def normalization_flags(c: Column) -> Column:
    return F.array_compact(F.array(
        F.when(c.contains("â€") | c.contains("Â"), "mojibake_bullet"),
        F.when(c.contains("&amp;") | c.contains("&lt;") | c.contains("&gt;"), "html_entity"),
        F.when(c.contains("<!--") | F.lower(c).contains("<image"), "html_residue")))


def strip_html(c: Column, full_entities: bool = False) -> Column:
    t = F.regexp_replace(c, r"(?is)<script.*?>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = unescape_all(t) if full_entities else unescape_named(t)
    return strip(F.regexp_replace(t, r"\s+", " "))


def normalize_path(c: Column, unicode_form: bool = False) -> Column:
    p = strip(F.coalesce(c, F.lit("")))
    if unicode_form:
        p = nfkc(p)
    p = F.lower(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+", "/"))
    return F.regexp_replace(p, r"^\./", "")


def sentences(c: Column, min_len: int = 0) -> Column:
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: norm_ws(s))
    return F.filter(parts, lambda s: F.length(s) >= min_len) if min_len else parts


def best_snippet(text: Column, hint: Column, max_len: int = 320) -> Column:
    """Short text as it is; else the sentence with most hint words (first wins ties)."""
    t = norm_ws(text)
    rx = F.lit("([a-z0-9À-ɏ]+)")
    hints = F.array_distinct(F.regexp_extract_all(F.lower(hint), rx, F.lit(1)))
    best = let(hints, lambda h: F.array_max(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s, i: F.struct(
        F.when(F.length(s) < 12, 0).otherwise(F.size(F.array_intersect(
            h, F.array_distinct(F.regexp_extract_all(F.lower(s), rx, F.lit(1)))))).alias("ov"),
        (-i).alias("neg"), s.alias("s")))))
    return F.when(F.length(t) <= max_len, t).when(
        best["ov"] > 0, F.substring(best["s"], 1, max_len)).otherwise(F.substring(t, 1, max_len))


def extractive_answer(question: Column, text: Column, insufficient: str = "insufficient information") -> Column:
    """First two sentences sharing two question words, else the first two sentences."""
    qs = token_set(question)
    sents = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    good = let(qs, lambda q: F.slice(F.filter(sents, lambda s: F.size(F.array_intersect(q, token_set(s))) >= 2), 1, 2))
    pick = F.when(F.size(good) > 0, F.transform(good, lambda s: strip(s))).otherwise(F.slice(sents, 1, 2))
    out = strip(F.array_join(pick, " "))
    return F.when(out == "", F.lit(insufficient)).otherwise(out)


def pad_id(number: Column, width: int) -> Column:
    """A number as text with leading zeros up to ``width``; longer numbers stay whole (``lpad`` alone would cut them)."""
    s = number.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def content_id(document: Column, index: Column, text: Column) -> Column:
    """md5 over document id, index and the whole text: equal only for the same chunk of the same document."""
    return F.md5(F.concat_ws("_", document.cast("string"), index.cast("string"), text))


def text_fingerprint(c: Column, head: int | None = None) -> Column:
    n = norm_ws(c, lower=True)
    return F.md5(F.substring(n, 1, head) if head else n)


def cluster_fingerprint(c: Column, n_words: int = 6, n_numbers: int = 5, min_len: int = 5) -> Column:
    """First long words and first numbers joined by a pipe."""
    words = F.slice(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{%d,})" % min_len), F.lit(1)), 1, n_words)
    nums = F.slice(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), 1, n_numbers)
    return F.concat_ws("|", words, nums)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def occurrences(c: Column, pattern: str, context: int) -> Column:
    """Array of struct(match, snippet) for every place of a pattern, with characters around it, left to right.

    One run over each text that holds the pattern at all, by Arrow batch; the
    others do not leave the JVM. Classes such as ``\\d`` and ``\\w`` are those of ASCII.
    """
    find = re.compile(pattern, re.ASCII).finditer

    def places(texts: pa.Array) -> pa.Array:
        at, match, snippet = [0], [], []
        for t in texts.to_pylist():
            for m in find(t or ""):
                match.append(m.group())
                snippet.append(t[max(m.start() - context, 0):m.end() + context])
            at.append(len(match))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(match, pa.string()), pa.array(snippet, pa.string())], ["match", "snippet"]))
    return F.arrow_udf(places, "array<struct<match:string,snippet:string>>")(F.when(c.rlike(pattern), c))


def strip_header_lines(c: Column, prefixes=("record_id:", "doc_id:", "company:", "year:", "source:", "source_path:")) -> Column:
    """Text without the metadata lines put before it."""
    rx = "^(?:" + "|".join(prefixes) + ")"
    return F.array_join(F.filter(F.split(c, "\n"), lambda ln: ~strip(ln).rlike(rx)), "\n")


def sql_like_slug(c: Column, cut: int | None = None) -> Column:
    """Lower-case slug used for document ids; whole, since a cut one could stand for two paths."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9가-힣]+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, cut) if cut else s


def replace_first(c: Column, needle: str, value: Column) -> Column:
    """Replace the first plain occurrence only."""
    pos = F.locate(needle, c)
    return F.when(pos > 0, F.concat(F.substring(c, F.lit(1), pos - 1), value,
                                    F.substring(c, pos + len(needle), F.length(c)))).otherwise(c)


def rewrite_for_company(q: Column, display: Column, generic=("this company", "the company"),
                        metric_words=("emission", "employees", "revenue")) -> Column:
    """Generic company words become the name, once; metric questions get it as a prefix."""
    out = q
    for g in generic:
        out = F.when(out.contains(display), out).otherwise(replace_first(out, g, display))
    metric = F.lower(out).rlike("|".join(metric_words))
    return F.when(metric & ~out.contains(display), F.concat_ws(" ", display, out)).otherwise(out)


def expand_query(q: Column, hints) -> Column:
    """Append the needles of every hint whose trigger occurs, each once.

    ``hints``: list of (triggers, needles, weight).
    """
    low = norm_ws(q, lower=True)
    found = F.flatten(F.array(*[
        F.when(_any(low, trig), F.array(*[F.lit(n.lower()) for n in needles])).otherwise(
            F.array().cast("array<string>")) for trig, needles, _ in hints]))
    extra = F.array_join(F.array_distinct(found), " ")
    return F.when(extra == "", q).otherwise(F.concat_ws(" ", q, extra))


def _any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out
