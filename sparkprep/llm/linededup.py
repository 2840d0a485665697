"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line's leaf is its number of tokens and its leading tokens, with tokens that hold digits
generalised. Within a leaf a token is constant where enough lines share it at its place and a variable field elsewhere;
the constant tokens are the line's template. Templates that recur in enough different texts are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_key, word_list

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 10
MIN_CONSTANT = 0.6
MAX_SHARE = 0.5
FIELD = "<*>"


def line_words(line: Column) -> Column:
    """`word_list` of a line without a line feed; lines that have no white space but spaces are split without a regular expression."""
    other = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.when(other, word_list(line)).otherwise(F.array_remove(F.split(line, " "), ""))


def recurring_lines(
    df: DataFrame, text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT,
) -> DataFrame:
    """(key, lines, words): for each text with recurring lines, their numbers from 0 and their words in sum.

    `key` is `text_key` of the text. Lines of fewer than `min_tokens` tokens have no template. A template counts once for
    each different text, so copies of a whole document add nothing.
    """
    body = F.col(text).cast("string")
    lines = df.select(text_key(body).alias("key"), F.xxhash64(body).alias("doc"), F.posexplode(F.split(body, "\n")).alias("line", "s")).select(
        "key", "doc", "line", F.explode(F.array(line_words(F.col("s")))).alias("tokens")  # exploded, so that a filter below doesn't split again
    ).where(F.size("tokens") >= min_tokens)
    lead = F.transform(F.slice("tokens", 1, depth), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    lines = lines.withColumn("leaf", F.xxhash64(F.size("tokens"), lead))
    # The leaves that can hold a recurring template; only their lines go on.
    leaves = cut_lineage(
        lines.select("leaf", "doc").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    )
    rows = cut_lineage(lines.join(leaves, "leaf", "left_semi").select("key", "line", "doc", "leaf", "tokens").dropDuplicates(["key", "line"]))
    cells = rows.select("key", "line", "doc", "leaf", F.posexplode("tokens").alias("at", "token"))
    constant = cells.groupBy("leaf", "at", "token").count().where(F.col("count") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("fixed"))
    marked = cells.join(constant, ["leaf", "at", "token"], "left")
    templates = marked.groupBy("key", "line", "doc", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.count("fixed").alias("n_fixed"),
        F.xxhash64(F.sort_array(F.collect_list(F.when(F.col("fixed"), F.struct("at", "token"))))).alias("template"),
    ).where(F.col("n_fixed") >= min_constant * F.col("n"))
    templates = cut_lineage(templates.select("key", "line", "doc", "leaf", "template", "n"))
    often = templates.select("leaf", "template", "doc").distinct().groupBy("leaf", "template").count().where(F.col("count") >= min_docs)
    return templates.join(often, ["leaf", "template"], "left_semi").groupBy("key").agg(
        F.sort_array(F.collect_list("line")).alias("lines"), F.sum("n").alias("words")
    )


def dedup_lines(df: DataFrame, text: str = "text", max_share: float = MAX_SHARE, **how) -> DataFrame:
    """`df` with its recurring lines dropped from `text`, and the columns n_lines and n_dropped (existing ones are replaced).

    A text whose recurring lines have more than `max_share` of its words is itself a copy or a form, which is a matter for
    document dedup: it stays as it is. NULL stays NULL with zero lines; an empty text has one line. Rows are neither
    dropped nor merged.
    """
    keep = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    body = F.col(f"`{text}`").cast("string")
    found = recurring_lines(df, text, **how).select(F.col("key").alias("__key"), F.col("lines").alias("__lines"), F.col("words").alias("__words"))
    joined = df.select(*[F.col(f"`{c}`") for c in keep], text_key(body).alias("__key")).join(found, "__key", "left")
    drops = F.col("__lines").isNotNull() & (F.col("__words") <= max_share * F.size(word_list(body)))
    left = F.array_join(F.filter(F.split(body, "\n"), lambda s, i: ~F.array_contains("__lines", i)), "\n")
    return joined.select(
        *[F.when(drops, left).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in keep],
        F.coalesce(F.size(F.split(body, "\n")), F.lit(0)).alias("n_lines"), F.when(drops, F.size("__lines")).otherwise(F.lit(0)).alias("n_dropped"),
    )


def template_lines(
    df: DataFrame, text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT,
) -> DataFrame:
    """(key, lines, words, templates): as `recurring_lines`, at every scale of the input, and a key of the text's set of templates.

    How often a token must be shared to be constant depends on its leaf: thresholds rise from `min_docs` by half powers of
    two, and a line recurs if its template at any of them is constant enough and in enough different texts. Values of a
    field that reach `min_docs` lines are thus told from the constants, which have more. Each threshold is tried with and
    without the tokens that hold digits. Lines of fewer than `min_tokens` tokens have a leaf of their own with exact tokens.
    """
    body = F.col(text).cast("string")
    lines = df.select(text_key(body).alias("key"), F.xxhash64(body).alias("doc"), F.posexplode(F.split(body, "\n")).alias("line", "s")).select(
        "key", "doc", "line", F.explode(F.array(line_words(F.col("s")))).alias("tokens")  # exploded, so that a filter below doesn't split again
    ).where(F.size("tokens") > 0)
    lead = F.transform(F.slice("tokens", 1, depth), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    lead = F.when(F.size("tokens") >= min_tokens, lead).otherwise(F.col("tokens"))
    lines = lines.withColumn("leaf", F.xxhash64(F.size("tokens"), lead))
    leaves = cut_lineage(
        lines.select("leaf", "doc").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    )
    rows = cut_lineage(lines.join(leaves, "leaf", "left_semi").select("key", "line", "doc", "leaf", "tokens").dropDuplicates(["key", "line"]))
    cells = rows.select("key", "line", "doc", "leaf", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
    shared = cells.groupBy("leaf", "at", "token").count().where(F.col("count") >= min_docs).select(
        "leaf", "at", "token", F.floor(2 * F.log2(F.col("count") / min_docs)).alias("level")
    )
    # Only shared cells count; a template is the exclusive-or of its cells, so thresholds add up from the highest.
    cell, plain = F.xxhash64("at", "token"), ~F.col("token").rlike("[0-9]")
    steps = cells.join(shared, ["leaf", "at", "token"]).groupBy("key", "line", "doc", "leaf", "n", "level").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(cell).alias("x"), F.count_if(plain).alias("pc"), F.bit_xor(F.when(plain, cell)).alias("px"),
    )
    down = Window.partitionBy("key", "line").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = F.array(
        F.struct(F.sum("c").over(down).alias("c"), F.bit_xor("x").over(down).alias("x")), F.struct(F.sum("pc").over(down).alias("c"), F.bit_xor("px").over(down).alias("x")),
    )
    templates = steps.select("key", "line", "doc", "leaf", "n", both.alias("both")).select(
        "key", "line", "doc", "leaf", "n", F.explode(F.array_distinct("both")).alias("t")
    ).where(F.col("t.c") >= min_constant * F.col("n"))
    templates = cut_lineage(templates.select("key", "line", "doc", "leaf", F.col("t.x").alias("template"), "n"))
    often = templates.select("leaf", "template", "doc").distinct().groupBy("leaf", "template").count().where(F.col("count") >= min_docs)
    # The most general recurring template of a line stands for it in the text's set.
    found = templates.join(often, ["leaf", "template"]).groupBy("key", "line").agg(
        F.max("n").alias("n"), F.max(F.struct("count", "leaf", "template")).alias("top"))
    return found.groupBy("key").agg(
        F.sort_array(F.collect_list("line")).alias("lines"), F.sum("n").alias("words"),
        F.xxhash64(F.sort_array(F.collect_set(F.struct("top.leaf", "top.template")))).alias("templates"),
    )


def drop_recurring(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """`dedup_lines` by `template_lines`: recurring lines go whatever their share of the text.

    Of the texts that would be left without words, one stays as it is for each set of templates.
    """
    keep = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    body = F.col(f"`{text}`").cast("string")
    found = cut_lineage(template_lines(df, text, **how).select(*[F.col(c).alias(f"__{c}") for c in ("key", "lines", "words", "templates")]))
    joined = df.select(*[F.col(f"`{c}`") for c in keep], text_key(body).alias("__key")).join(found, "__key", "left")
    whole = df.select(text_key(body).alias("__key"), F.size(word_list(body)).alias("__n")).join(found, "__key").where("__words = __n")
    stay = cut_lineage(whole.groupBy("__templates").agg(F.min("__key").alias("__key")).select("__key", F.lit(True).alias("__stay")))
    joined = joined.join(stay, "__key", "left")
    drops = F.col("__lines").isNotNull() & F.col("__stay").isNull()
    left = F.array_join(F.filter(F.split(body, "\n"), lambda s, i: ~F.array_contains("__lines", i)), "\n")
    return joined.select(
        *[F.when(drops, left).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in keep],
        F.coalesce(F.size(F.split(body, "\n")), F.lit(0)).alias("n_lines"), F.when(drops, F.size("__lines")).otherwise(F.lit(0)).alias("n_dropped"),
    )
