"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip, card (Luhn), phone, iban (mod 97), secret (a run of 20 or more letters, digits and _/+- with both
letters and digits). Offsets are code points, the end is exclusive. Within a kind, spans are the leftmost
non-overlapping matches; a match that its validator refuses is dropped without a retry.

A span's score is its kind's own, more if a word of CONTEXT_WORDS stands in the CONTEXT characters before it (behind
the span before), less if one of DOUBT_WORDS does. Spans of the base kinds stay whatever their score; the added kinds
need LEAST_SCORE: a secret needs a word such as "token" near it, and is dropped behind "example token" or "commit"; an
IBAN is dropped behind "example", unless "account" or the like stands there too.

Every pattern starts at the end of the last match (\\G) and uses possessive loops, so that a text costs
time in proportion to its length and long runs cannot overflow the stack.

Null texts count as empty: no span. Rows are independent of each other, so repeated rows, ties and null
ids give repeated results. Columns of the input other than the id and the text are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicework.llm.common import running_total

#: kind -> (what has to stand before a match, the match, a cheap test that a text needs to pass to have one)
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))", r"[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\."),
    "card": (r"(?:\G|(?<![0-9]))", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){12}[0-9]"),
    "phone": ("", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?:^|[^A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "secret": (r"(?:\G|(?<![A-Za-z0-9_/+-]))", r"[A-Za-z0-9_/+-]{20,}+", r"[A-Za-z0-9_/+-]{20}"),
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

#: Words that, in the CONTEXT characters before a span, raise its score; and words that lower it.
CONTEXT_WORDS = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|payment|credit",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "secret": r"token|secret|passw|\bkey\b|api[_-]?key|access[_-]?key|credential|bearer|authorization",
}
DOUBT_WORDS = r"example|sample|dummy|placeholder|\bcommit\b|checksum|\bsha-?[0-9]|\bmd5\b|digest"
CONTEXT = 40
#: Score in percent: of the pattern alone, what a context word adds, and what a word of doubt takes.
SCORES = {"email": (80, 15, 20), "ip": (60, 30, 20), "card": (80, 15, 20), "phone": (60, 30, 20), "iban": (60, 30, 20), "secret": (30, 40, 30)}
#: Added kinds need this score.
LEAST_SCORE = 50


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether a string of 1 to 19 digits passes the Luhn check."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (i % 2 + 1))
    # twice a digit, less 9 where that is above 9
    value = F.transform(from_right, lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97, its first four characters moved to the end."""
    chars = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        d = _digits(hit)
        return F.length(d).between(13, 19) & luhn(F.substring(d, 1, 19))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        bare = F.replace(hit, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & mod97(bare)
    if kind == "secret":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def with_spans(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds, for each kind, a column pii_<kind>: array<struct<start int, end int, score int>>."""
    own = df
    none = F.array().cast("array<string>")
    for kind in kinds:
        own = own.withColumn(f"_gaps_{kind}", _found(F.col(text_col), kind, 1, none)).withColumn(f"_hits_{kind}", _found(F.col(text_col), kind, 2, none))
    for kind in kinds:
        own = own.withColumn(f"_ends_{kind}", running_total(F.zip_with(f"_gaps_{kind}", f"_hits_{kind}", lambda g, h: F.length(g) + F.length(h))))
    for kind in kinds:
        own = own.withColumn(f"pii_{kind}", _spans(kind))
    return own.drop(*(f"_{part}_{kind}" for kind in kinds for part in ("gaps", "hits", "ends")))


def _found(text: Column, kind: str, group: int, none: Column) -> Column:
    before, pattern, test = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?{before})({pattern})"), F.lit(group))
    return F.when(text.contains(test) if kind == "email" else text.rlike(test), found).otherwise(none)


def _score(kind: str, gap: Column) -> Column:
    alone, more, less = SCORES[kind]
    near = F.lower(F.right(gap, F.lit(CONTEXT)))
    return alone + F.when(near.rlike(CONTEXT_WORDS[kind]), more).otherwise(0) - F.when(near.rlike(DOUBT_WORDS), less).otherwise(0)


def _spans(kind: str) -> Column:
    every = F.zip_with(
        F.arrays_zip(F.col(f"_gaps_{kind}").alias("gap"), F.col(f"_hits_{kind}").alias("hit")),
        F.col(f"_ends_{kind}"),
        lambda z, e: F.struct((e - F.length(z["hit"])).alias("start"), e.alias("end"), _score(kind, z["gap"]).alias("score"), _valid(kind, z["hit"]).alias("valid")),
    )
    least = F.lit(0 if kind in BASE_KINDS else LEAST_SCORE)
    return F.transform(F.filter(every, lambda s: s["valid"] & (s["score"] >= least)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    def of(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def scored(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.concat(*(F.transform(f"pii_{k}", lambda s: s["score"].cast("string")) for k in kinds)), ",")


#: Code points of the pieces that redact() cuts a text into, so that no cut walks the whole text.
PIECE = 4096


def redact(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The same rows and columns; in the text, each span that detect() finds is replaced by its kind in brackets.

    All spans are those of the text as it came in; spans that overlap are replaced together, by the kind of the first
    (the longest of those, then by kind). Texts without a span stay as they are; null stays null."""
    own = with_spans(df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text")), "text", kinds)

    def spans(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind.upper()).alias("kind")))

    own = own.select("row", "text", F.array_sort(F.concat(*map(spans, kinds))).alias("spans"))
    own = own.withColumn("reach", running_total(F.transform("spans", lambda s: -s["back"]), merge=lambda a, b: F.greatest(a, b)))
    own = own.withColumn("before", F.slice(F.concat(F.array(F.lit(0)), "reach"), 1, F.size("spans")))
    some = F.size("spans") > 0
    own = own.withColumn("pieces", F.when(some, F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))))

    def cut(a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        return F.when(b > a, F.substring(F.array_join(F.slice("pieces", first + 1, last - first + 1), ""), a - first * PIECE + 1, b - a)).otherwise("")

    replaced = F.zip_with("spans", "before", lambda s, at: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
    done = F.element_at("reach", -1)
    clean = F.when(some, F.concat(F.array_join(replaced, ""), cut(done, F.length("text")))).otherwise(F.col("text"))
    return own.select("row", clean.alias("clean")).select(*(F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: n_email, n_ip, n_card, n_phone, base_sha256, spans, scores."""
    own = with_spans(docs.select(F.col(id_col), F.col(text_col).alias("_text_")), "_text_")
    return own.select(
        F.col(id_col),
        *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        scored(KINDS).alias("scores"),
    )
