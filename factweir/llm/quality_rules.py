"""Quality rules, line first: failing lines go, then documents that lost too much of their text.

Lines are judged by punctuation (shouting, or symbols on most words), navigation (words between separators)
and boilerplate rules. Base statistics of the whole text come beside it. Only DataFrame expressions are used.

Defined results: a null text counts as empty (no words, not kept); lines without a word are neither judged
nor kept in the cleaned text; rows are independent, so repeated rows and null ids get a row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweir.llm.common import SPACE_CHARS, pick

SYMBOLS = "#*$%&|<>"

#: Phrases of page furniture in English, German, Spanish and French. A line is boilerplate if such phrases
#: make up a quarter of its words or more; one that mentions them among others is prose.
BOILERPLATE = (
    "accept all cookies", "accept cookies", "add to cart", "all rights reserved", "click here to", "cookie policy", "cookie settings", "enable javascript",
    "javascript is disabled", "javascript is required", "lorem ipsum", "page not found", "privacy policy", "sign up for our newsletter", "skip to content",
    "skip to main content", "subscribe to our newsletter", "terms and conditions", "terms of service", "terms of use", "this website uses cookies",
    "we use cookies", "your browser does not support",
    "alle akzeptieren", "alle rechte vorbehalten", "datenschutzerklärung", "diese website verwendet cookies", "hier klicken", "in den warenkorb",
    "newsletter abonnieren", "nutzungsbedingungen", "wir verwenden cookies", "zum inhalt springen",
    "aceptar cookies", "aviso legal", "añadir al carrito", "haga clic aquí", "política de cookies", "política de privacidad", "saltar al contenido",
    "suscríbete a nuestro boletín", "términos y condiciones", "todos los derechos reservados", "utilizamos cookies",
    "abonnez-vous à notre newsletter", "accepter les cookies", "ajouter au panier", "aller au contenu", "cliquez ici", "conditions d'utilisation",
    "mentions légales", "nous utilisons des cookies", "politique de confidentialité", "tous droits réservés",
)
FURNITURE_SHARE = 4


def _keys() -> list[str]:
    """Words of which a text with a phrase holds one: the longest of each phrase, without those that hold another."""
    longest = {max(p.split(), key=len) for p in BOILERPLATE}
    return sorted(k for k in longest if not any(o != k and o in k for o in longest))


_NOT_SPACE = r"[^\x20\x09-\x0D]"
_WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """The runs without ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def line_failure(line: Column, maybe: Column | None = None) -> Column:
    """Why a line fails: navigation, boilerplate or punctuation; null if it passes.

    Navigation: three separators ` | ` or more, or at least one and every third word. Punctuation: half the
    words or more end in a run of symbols or of exclamation marks.
    """
    n_words = F.regexp_count(line, F.lit(f"{_NOT_SPACE}+"))
    bars = F.regexp_count(line, F.lit(r"(?<!\S)[|>•·](?!\S)"))
    phrases, low = F.lit("|".join(BOILERPLATE)), F.lower(line)
    plain = F.regexp_count(low, F.lit(_WORD))
    other = F.regexp_count(F.call_function("regexp_replace", low, phrases, F.lit(" ")), F.lit(_WORD))
    maybe = F.lit(True) if maybe is None else maybe
    marked = F.regexp_count(line, F.lit(r"(?:[#*$%&]{2,}|!{2,})[.,]?(?!\S)"))
    return (
        F.when((bars >= 3) | ((bars >= 1) & (3 * bars >= n_words)), "navigation")
        .when(maybe & F.regexp_like(low, phrases) & (FURNITURE_SHARE * (plain - other) >= plain), "boilerplate")
        .when((marked >= 1) & (2 * marked >= n_words), "punctuation")
    )


def may_hold_phrase(text: Column) -> Column:
    """Whether a text in lower case holds one of the words that a phrase of page furniture can't do without."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in _keys()])


def _repeated_words(grams: Column, n_words: Column) -> Column:
    """Words inside 3-word windows that come twice or more.

    grams: hash and position of every window, sorted. Windows equal to a neighbour are repeated; their
    positions in order cover three words each, less what the next one covers again.
    """
    last = F.size(grams) - 1
    same = F.filter(grams, lambda g, i: ((i > 0) & (F.get(grams, i - 1)["h"] == g["h"])) | ((i < last) & (F.get(grams, i + 1)["h"] == g["h"])))
    places = F.sort_array(F.transform(same, lambda g: g["p"]))
    cover = F.aggregate(
        places,
        F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("at")),
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["at"])).alias("sum"), p.alias("at")),
        lambda a: a["sum"],
    )
    return F.when(n_words < 3, F.lit(0)).otherwise(cover)


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 50, max_repeat: int = 50, max_lost: int = 50) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lost_lines, lost_chars and clean_text (lines that passed).

    base_failed: fewer than min_words words, or over max_repeat percent repeated words. kept: not
    base_failed, and failing lines hold at most max_lost percent of the characters of lines with a word.
    """
    base = pick(docs, id_column, text_column).toDF("id", "t").withColumn("t", F.coalesce("t", F.lit("")))
    base = base.withColumn("low", F.lower("t"))
    step = base.select(
        "id",
        "t",
        may_hold_phrase(F.col("low")).alias("maybe"),
        words_of(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(_NOT_SPACE))).alias("lines"),
    )
    grams = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")))
    step = step.select(
        "id",
        F.size("words").alias("n_words"),
        F.length(F.translate("t", SPACE_CHARS, "")).alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.sort_array(grams).alias("grams"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), line_failure(x, F.col("maybe")).alias("why"))).alias("lines"),
    )
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x["line"]))
    step = step.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _repeated_words(F.col("grams"), F.col("n_words")).alias("n_repeat_words"),
        F.filter("lines", lambda x: x["why"].isNotNull()).alias("failed"),
        F.filter("lines", lambda x: x["why"].isNull()).alias("passed"),
    )
    step = step.withColumn("base_failed", (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    step = step.withColumns({"lost_lines": F.size("failed"), "lost_chars": chars(F.col("failed")), "left_chars": chars(F.col("passed"))})
    lost = F.lit(100).cast("long") * F.col("lost_chars") > max_lost * (F.col("lost_chars") + F.col("left_chars"))
    long = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return step.select(
        F.col("id").alias(id_column),
        *long,
        "base_failed",
        (~F.col("base_failed") & ~lost).alias("kept"),
        F.col("lost_lines").cast("long").alias("lost_lines"),
        F.col("lost_chars").cast("long").alias("lost_chars"),
        F.array_join(F.transform("passed", lambda x: x["line"]), "\n").alias("clean_text"),
    )
