"""Line-first cleaning with DataFrame functions only: no shuffle, no Python.

Every line of the whole text is held against three rules; lines that break one are removed; a document that loses too
large a part of its characters, or that fails the base rules, is rejected.

- punctuation: a line of words without a letter; or with more runs of symbols or doubled marks than SYMBOL_SHARE of its
  words; or with LONG words or more and no sentence mark;
- navigation: two or more separators (bars, arrows, dots between words; dashes, slashes and angles that stand alone), at least
  one to every four words;
- boilerplate: a short line (up to SHORT words) with one of BOILERPLATE, in English, German, French or Spanish.

Defined results: a null text counts as empty; an empty text has no words, fails the base rules and cleans to ''; rows are
judged one by one, so repeated rows get equal results; extra columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8  # the windows are hashed by doubling: a power of two
SYMBOL_SHARE, LONG, SHORT = 0.3, 40, 25
#: A document goes if less than this share of its characters is left.
MIN_LEFT = 0.5

#: Phrases of page furniture.
BOILERPLATE = (
    "all rights reserved|cookie policy|cookie settings|accept cookies|uses cookies|privacy policy|terms of use|terms of service|terms and conditions|"
    "click here|read more|share this|sign up|sign in|log in|subscribe to|newsletter|powered by|enable javascript|skip to content|back to top|lorem ipsum|"
    "alle rechte vorbehalten|cookie-einstellungen|cookies akzeptieren|verwendet cookies|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|hier klicken|weiterlesen|mehr erfahren|jetzt anmelden|abonnieren|nach oben|zum inhalt springen|"
    "tous droits réservés|politique de confidentialité|politique de cookies|accepter les cookies|utilise des cookies|conditions d.utilisation|mentions légales|cliquez ici|lire la suite|en savoir plus|se connecter|s.inscrire|s.abonner|retour en haut|aller au contenu|"
    "todos los derechos reservados|política de privacidad|política de cookies|aceptar cookies|utiliza cookies|términos de uso|términos y condiciones|aviso legal|haga clic aquí|haz clic aquí|leer más|seguir leyendo|iniciar sesión|suscríbete|volver arriba|saltar al contenido"
)
BARS = r"[|»›·•→]|(?:^|[ \t])[>/-](?:$|[ \t])"
_SPACE = r"[ \t\n\x0B\f\r]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE + "+"), "")


def shifted(items: Column, k: int) -> list[Column]:
    n = F.greatest(F.size(items), F.lit(1))
    return [items, *(F.slice(items, j + 1, n) for j in range(1, k))]


def with_window_hashes(df: DataFrame) -> DataFrame:
    """df with column h: hashes of all windows of 8 of its words, made of hashes of 4, of 2, and of words. A column each: an
    expression that stood twice in the next one would be evaluated twice."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        pairs = F.zip_with("h", F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))), lambda x, y: F.xxhash64(x, y))
        df = df.withColumn("h", F.slice(pairs, 1, F.greatest(F.size("h") - k, F.lit(0))))
    return df


def judged_lines(lines: Column) -> Column:
    """lines as structs of the text and its counts, so that each is looked through once for each rule."""
    return F.transform(
        lines,
        lambda x: F.struct(
            x.alias("x"),
            F.regexp_count(x, F.lit(r"[^ \t\n\x0B\f\r]+")).alias("n"),
            F.regexp_count(x, F.lit(r"[#*$%&|<>=_~^]+|[!?]{2,}")).alias("marks"),
            F.regexp_count(x, F.lit(BARS)).alias("bars"),
        ),
    )


def line_passes(s: Column) -> Column:
    punctuation = (s["n"] > 0) & ((s["marks"] > SYMBOL_SHARE * s["n"]) | ~s["x"].rlike(r"\p{L}") | ((s["n"] >= LONG) & ~s["x"].rlike(r"[.!?;:]")))
    navigation = (s["bars"] >= 2) & (4 * s["bars"] >= s["n"])
    boilerplate = (s["n"] <= SHORT) & F.lower(s["x"]).rlike(BOILERPLATE)
    return ~(punctuation | navigation | boilerplate)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t\n\x0B\f\r]")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_share, kept, cleaned, then the columns in keep
    (as __0, __1, ...)."""
    held = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep or [])]
    names = [f"__{i}" for i in range(len(held))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("id"), text.alias("text"), words_of(F.col(text_col)).alias("words"), F.split(text, "\n").alias("lines"), *held)
    n = F.size("words")
    b = with_window_hashes(a)
    # windows found twice: sorted by hash, each beside its neighbours
    twice = F.size(F.array_distinct("h")) < F.size("h")
    c = b.select("*", F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")).alias("s"))
    beside = F.arrays_zip(F.col("s").alias("s"), F.concat(F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.col("s")).alias("p"), F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))).alias("f"))
    same = F.filter(beside, lambda z: (z["s"]["x"] == z["p"]["x"]) | (z["s"]["x"] == z["f"]["x"]))
    d = c.select("*", F.when(F.size("s") > 0, F.sort_array(F.transform(same, lambda z: z["s"]["i"]))).otherwise(F.array().cast("array<int>")).alias("at"))
    steps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))).cast("long"))
    worded = F.filter("lines", has_word)
    e = d.select(
        "id", "text", "lines", *names,
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.filter(judged_lines(F.col("lines")), line_passes).alias("good"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    f = e.select("*", failed.alias("base_failed"), F.array_join(F.col("good.x"), "\n").alias("cleaned"))
    left = F.when(F.length("text") > 0, F.length("cleaned") / F.length("text")).otherwise(F.lit(0.0))
    g = f.select("*", left.alias("left_share"))
    kept = ~F.col("base_failed") & (F.col("left_share") >= MIN_LEFT)
    return g.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_share", kept.alias("kept"), "cleaned", *names)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs that are kept, with the cleaned text (and its length in length_col, if given), columns as in docs."""
    columns = docs.columns
    # the row number keeps the optimizer from moving the filter below the columns it is made of, which would repeat their work
    out = judge(docs, id_col, text_col, keep=columns).withColumn("row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("row") >= 0))
    at = {c: F.col(f"__{i}") for i, c in enumerate(columns)}
    at[text_col] = F.col("cleaned")
    if length_col in at:
        at[length_col] = F.length("cleaned").cast(docs.schema[length_col].dataType)
    return out.select(*(c.alias(name) for name, c in at.items()))
