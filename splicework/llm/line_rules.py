"""Line-first cleaning: rules per line, failing lines removed, texts that lose too much rejected.

A line (split at "\\n") with a word fails if one of these holds; none of them but the phrases depends on a language:
  punctuation  marks such as "!!", "???" or "###" stand at LOUD percent of its words or more, or it has
               neither closing punctuation nor LEAST_WORDS words;
  letters      less than LETTERS percent of its characters outside white space are letters of any script;
  navigation   bars, arrows or bullets make up NAV percent of its words or more, NAV_LEAST of them at least, or
               web addresses do LINKS percent;
  boilerplate  it has no more than BOILERPLATE_WORDS words and a phrase of BOILERPLATE (English, French, German and
               Spanish), or it repeats an earlier line that does not fail, whatever its length.
A text is rejected if more than MOST_LOST percent of its words stand in failing lines.

Null and empty texts have no word: they fail the base rules. Rows do not depend on each other, so ties,
repeated rows and null ids give a result each. Other columns are not touched. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicework.llm.common import WORD, n_words, words

LOUD, LEAST_WORDS, LETTERS, NAV, NAV_LEAST, LINKS, BOILERPLATE_WORDS, MOST_LOST = 30, 4, 40, 20, 3, 50, 25, 30
MARKS = r"[!?#*$%&<>]{2,}"
SYMBOLS = r"[#*$%&|<>]"
NAV_MARKS = r"[|»›•·→]"
CLOSED = r"[.!?…:;,)\]\"'”’»][\x20\x09-\x0D]*$"
LINK = r"(?i)(?:https?://|www\.)[^\x20\x09-\x0D]"
NO_LETTERS = r"[^\p{L}]+"
BOILERPLATE = (
    r"(?i)cookie|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|lorem ipsum|click here|sign up|subscribe|log in|read more|share this"
    r"|politique de confidentialité|tous droits réservés|conditions d.utilisation|cliquez ici|se connecter|lire la suite|mentions légales"
    r"|datenschutz|alle rechte vorbehalten|nutzungsbedingungen|hier klicken|anmelden|weiterlesen|impressum"
    r"|política de privacidad|todos los derechos reservados|términos de (?:uso|servicio)|haga clic|iniciar sesión|leer más|aviso legal"
)
WINDOW = 5


def line_fails(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(WORD))
    nav = F.regexp_count(line, F.lit(NAV_MARKS))
    return (
        (F.regexp_count(line, F.lit(MARKS)) * 100 >= n * LOUD)
        | ((n < LEAST_WORDS) & ~line.rlike(CLOSED))
        | (F.length(F.regexp_replace(line, F.lit(NO_LETTERS), F.lit(""))) * 100 < F.length(F.regexp_replace(line, F.lit(r"[\x20\x09-\x0D]+"), F.lit(""))) * LETTERS)
        | (F.regexp_count(line, F.lit(LINK)) * 100 >= n * LINKS)
        | ((nav >= NAV_LEAST) & (nav * 100 >= n * NAV))
        | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def window_hashes(word_array: Column) -> Column:
    """A 64-bit hash of the words of each WINDOW-word window."""
    return F.transform(
        F.slice(word_array, 1, F.greatest(F.size(word_array) - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(word_array, i + k) for k in range(1, WINDOW))),
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, under names with _lr_ before them."""
    empty = F.array().cast("array<string>")
    text, order, at = F.col(text_col), F.col("_lr_order"), F.col("_lr_at")
    own = docs.select("*", words(text).alias("_lr_words"), F.coalesce(worded_lines(text), empty).alias("_lr_lines"))
    own = own.select("*", window_hashes(F.col("_lr_words")).alias("_lr_hashes"), F.filter("_lr_lines", lambda x: ~line_fails(x)).alias("_lr_passed"))
    # only texts with a repeated window, few texts, sort theirs; there, a repeated window stands beside its like
    some = F.size(F.array_distinct("_lr_hashes")) < F.size("_lr_hashes")
    own = own.select("*", F.when(some, F.array_sort(F.transform("_lr_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_lr_order"))
    like = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
    repeated = F.transform(order, lambda x, k: F.when(like(x, k - 1) | like(x, k + 1), x["i"]))
    own = own.select("*", F.sort_array(F.filter(repeated, lambda i: i.isNotNull())).alias("_lr_at"))
    new_words = F.transform(at, lambda i, k: F.when(k > 0, F.least(F.lit(WINDOW), i - F.get(at, k - 1))).otherwise(WINDOW))
    counts = {
        "n_words": F.size("_lr_words"),
        "word_chars": F.aggregate("_lr_words", F.lit(0), lambda a, w: a + F.length(w)),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)),
        "n_dup_lines": F.size("_lr_lines") - F.size(F.array_distinct("_lr_lines")),
        "n_repeat_words": F.coalesce(F.aggregate(new_words, F.lit(0), lambda a, x: a + x), F.lit(0)),
        "lost_words": F.size("_lr_words") - n_words(F.array_join(F.array_distinct("_lr_passed"), "\n")),
    }
    return own.select(*docs.columns, *(c.cast("long").alias(f"_lr_{k}") for k, c in counts.items()))


def base_failed() -> Column:
    return (F.col("_lr_n_words") < 10) | (100 * F.col("_lr_n_repeat_words") > 20 * F.col("_lr_n_words"))


def kept() -> Column:
    return ~base_failed() & (F.col("_lr_lost_words") * 100 <= F.col("_lr_n_words") * MOST_LOST)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, the counts, base_failed, kept, lost_words."""
    own = with_counts(docs.select(id_col, text_col), text_col)
    counts = (F.col(f"_lr_{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return own.select(id_col, *counts, base_failed().alias("base_failed"), kept().alias("kept"), F.col("_lr_lost_words").alias("lost_words"))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns, failing lines removed from their texts; lines without a word stay."""
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    own = with_counts(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")), "text")
    # a plain filter on kept() would be pushed below the counts, which it then repeats for each use of each
    own = own.select("row", F.explode_outer(F.when(kept(), F.array("text"))).alias("text")).where("text IS NOT NULL")
    passed = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: ~(worded(z["x"]) & line_fails(z["x"])))
    own = own.select("row", F.array_sort(passed).alias("by_line"))  # equal lines stand together, the first of them first
    first = F.filter("by_line", lambda z, k: ~worded(z["x"]) | F.coalesce(F.get("by_line", k - 1)["x"] != z["x"], F.lit(True)))
    in_order = F.array_sort(F.transform(first, lambda z: F.struct(z["i"].alias("i"), z["x"].alias("x"))))
    text = F.array_join(F.transform(in_order, lambda z: z["x"]), "\n")
    return own.select("row", text.alias("clean")).select(*(F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
