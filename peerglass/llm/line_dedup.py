"""Line dedup by a log-template tree.

A line's tokens are its runs of other than ASCII white space; tokens with a digit
are variable and read ``<*>``. The tree has a fixed depth: the number of tokens,
then the first ``depth`` tokens. In each leaf a token is kept at its position if at
least ``min_docs`` documents have it there, and generalised to ``<*>`` if not. A
line whose kept tokens make up at least ``similarity`` of all is an instance of the
resulting template; other lines stand for themselves, unmasked if their masked form
has too few constant tokens. A line whose template does not recur is tried with wider
ones, in which a kept token also has a share (``SHARES``) of its leaf's documents, so
that a field's values are generalised however many documents each has. Templates found in at least
``min_docs`` documents recur, and their lines are dropped, except for the first
(least document id) unless ``keep_first`` is false. The first ``depth`` tokens are the
same throughout a leaf; unless ``lead_counts``, similarity is that of the tokens after
them, of which at least two must be kept. Equal lines of more than ``long_line`` tokens
recur from two documents on, however few share them.

All steps are DataFrame functions. Texts are read for the keys of their lines, read
again for the tokens of leaves that can recur and hold several kinds of line, and
dealt once for the rebuilding; everything else moves hashes and numbers.

Defined results: null text stays null; lines without a token stay; a text without
recurring lines is unchanged, including its line ends (``\\n``); a text that loses
all lines is empty. Rows that repeat an id and text count as one document and are
treated alike; rows that repeat only the id are different documents. An empty
table gives an empty result. Other columns of the input are passed on, whatever their
names; given columns n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerglass.llm.prefix import join_same
from peerglass.sources.tables import durable

VARIABLE = "<*>"
SHARES = (0.001, 0.01, 0.1)  # of a leaf's documents, for lines whose finer template does not recur


def body_of(line: Column) -> Column:
    """The line's tokens between single spaces, variable ones masked.

    Lines without digits, and without white space to mend, are not rewritten. The pattern
    starts at a token's start only and never goes back, so a token costs its length.
    """
    masked = F.when(
        line.rlike("[0-9]"),
        F.regexp_replace(
            line,
            "(?<![^\\x20\\x09-\\x0D])[^0-9\\x20\\x09-\\x0D]*+[0-9][^\\x20\\x09-\\x0D]*+",
            VARIABLE,
        ),
    ).otherwise(line)
    spaced = F.trim(F.regexp_replace(masked, "[\\x20\\x09-\\x0D]+", " "))
    mend = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for part in ("  ", *map(chr, range(9, 14))):
        mend = mend | F.contains(line, F.lit(part))
    return F.when(mend, spaced).otherwise(masked)


def _keyed(
    docs: DataFrame, id_col: str, text_col: str, depth: int, similarity: float, long_line: int
) -> DataFrame:
    """A row per line with a token: document, line number, leaf, tokens, hash of the tokens.

    A line with too few constant tokens for any template is hashed unmasked.
    """
    # Bodies are made before the explode, so that they are made once, whatever reads them.
    lines = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("mark"),
        F.posexplode(
            F.transform(
                F.split(text_col, "\n"), lambda x: F.struct(body_of(x).alias("body"), x.alias("line"))
            )
        ).alias("line_no", "_of"),
    ).select("doc", "mark", "line_no", "_of.*")
    variable = F.size(F.filter(F.split("body", " "), lambda t: t == VARIABLE))
    n = F.length("body") - F.length(F.replace("body", F.lit(" "), F.lit(""))) + 1
    return lines.where("body != ''").select(
        "doc",
        "mark",
        "line_no",
        F.xxhash64(n, F.substring_index("body", " ", depth)).alias("leaf"),
        (n > long_line).alias("long"),
        F.when(
            F.contains("body", F.lit(VARIABLE)) & (n - variable < similarity * n),
            F.xxhash64(F.trim(F.regexp_replace("line", "[\\x20\\x09-\\x0D]+", " "))),
        ).otherwise(F.xxhash64("body")).alias("kind"),
        "body",
    )


def _templates(bodies: DataFrame, min_docs: int, similarity: float, lead: int = 0) -> DataFrame:
    """(leaf, kind, level, template) of kinds of line that are instances of wider templates.

    ``bodies``: leaf, kind, body, docs, leaf_docs. Tokens are counted by (leaf,
    position, token), so that a leaf with very many lines is spread over its tokens.
    Level 0 asks for ``min_docs`` documents, those after it for shares of the leaf's;
    a level that repeats the template of the one before it is left out. With ``lead``,
    only the tokens after so many count, of which two or more must be kept.
    """
    tokens = bodies.select(
        "leaf", "kind", "docs", "leaf_docs", F.posexplode(F.split("body", " ")).alias("at", "token")
    )
    held = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("in_docs"))
    # The highest level at which the token is constant; -1 at none.
    enough = F.col("in_docs") >= min_docs
    level = F.when(~enough | (F.col("token") == VARIABLE), -1)
    for i, share in reversed(list(enumerate(SHARES, 1))):
        level = level.when(F.col("in_docs") >= share * F.col("leaf_docs"), i)

    def kept(i: int) -> Column:
        return F.when(F.col("at") >= lead, F.when(F.col("upto") >= i, 1.0).otherwise(0.0))

    seen = (
        tokens.join(held, ["leaf", "at", "token"])
        .withColumn("upto", level.otherwise(0))
        .groupBy("leaf", "kind")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "token", "upto"))).alias("words"),
            *(
                F.when(F.sum(kept(i)) >= (2 if lead else 0), F.avg(kept(i))).alias(f"kept{i}")
                for i in range(len(SHARES) + 1)
            ),
        )
        .where(F.col("kept0") >= similarity)
    )

    def at_level(i: int) -> Column:
        words = F.transform(
            "words", lambda x: F.when(x["upto"] >= i, x["token"]).otherwise(VARIABLE)
        )
        new = (F.col(f"kept{i}") >= similarity) & (F.col(f"kept{i}") < F.col(f"kept{i - 1}")) if i else F.lit(True)
        return F.when(new, F.struct(F.lit(i).alias("level"), F.xxhash64(words).alias("template")))

    levels = F.array_compact(F.array(*(at_level(i) for i in range(len(SHARES) + 1))))
    return seen.select("leaf", "kind", F.inline(levels))


def _sieved(rows: DataFrame, wanted: DataFrame, slots: int = 2**18) -> DataFrame:
    """Rows whose leaf may be among the wanted ones.

    What is broadcast is the set of slots that wanted leaves hash to, at most
    ``slots`` numbers. With very many wanted leaves it lets all rows pass, and the
    join after it does the work.
    """
    slot = F.pmod(F.xxhash64("leaf"), F.lit(slots)).alias("_slot")
    taken = F.broadcast(wanted.select(slot).distinct())
    return rows.withColumn("_slot", slot).join(taken, "_slot", "left_semi").drop("_slot")


def drop_recurring_lines(
    documents: DataFrame,
    *,
    depth: int = 3,
    min_docs: int = 5,
    similarity: float = 0.6,
    keep_first: bool = True,
    lead_counts: bool = False,
    long_line: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents with recurring lines dropped, and n_lines, n_dropped (0 for null text)."""
    keyed = _keyed(documents, id_col, text_col, depth, similarity, long_line)
    every = durable(keyed.drop("body"), "line-keys")
    need = F.when(F.col("long"), 2).otherwise(min_docs)
    # Most lines stand alone in their leaf; they leave before anything is sorted by document.
    shared = every.groupBy("leaf", "long").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    lines = durable(
        _sieved(every, shared).join(shared.select("leaf"), "leaf", "left_semi"), "line-shared"
    )
    in_doc = lines.groupBy("leaf", "long", "kind", "doc", "mark").agg(F.min("line_no").alias("line_no"))
    kinds = in_doc.groupBy("leaf", "long", "kind").agg(
        F.count("*").alias("docs"), F.min(F.struct("doc", "mark", "line_no")).alias("of")
    )
    leaves = (
        kinds.groupBy("leaf", "long")
        .agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("leaf_kinds"))
        .where(F.col("leaf_docs") >= need)
        .drop("long")
    )
    # Kinds of line in leaves that can recur at all.
    able = durable(kinds.join(leaves, "leaf"), "line-kinds")
    wanted = able.where(F.col("leaf_kinds") > 1).where(F.col("leaf_docs") >= min_docs).select("leaf", "kind", "docs", "leaf_docs", "of.*")
    bodies = join_same(
        _sieved(keyed, wanted).select("doc", "mark", "line_no", "body"),
        wanted,
        ["doc", "mark", "line_no"],
    ).dropDuplicates(["leaf", "kind"])
    wider = _templates(
        bodies.select("leaf", "kind", "body", "docs", "leaf_docs"), min_docs, similarity,
        0 if lead_counts else depth,
    )
    named = able.select("leaf", "kind").join(wider, ["leaf", "kind"], "left").select(
        "leaf", "kind", F.coalesce("template", "kind").alias("template"),
        F.col("template").isNotNull().alias("wide"), F.coalesce("level", F.lit(0)).alias("level"),
    )
    # A long line that is an instance of a template may still recur by itself.
    alone = able.where("long").select(
        "leaf", "kind", F.col("kind").alias("template"), F.lit(False).alias("wide"), F.lit(len(SHARES) + 1).alias("level")
    )
    named = durable(named.where("wide").unionByName(alone).unionByName(
        named.join(able.where("NOT long").select("leaf", "kind"), ["leaf", "kind"], "left_semi").where("NOT wide")
    ), "line-templates")
    recurring = (
        in_doc.join(named, ["leaf", "kind"])
        .groupBy("leaf", "long", "template", "wide", "doc", "mark")
        .agg(F.min("line_no").alias("line_no"))
        .groupBy("leaf", "long", "template", "wide")
        .agg(F.count("*").alias("docs"), F.min(F.struct("doc", "mark", "line_no")).alias("first"))
        .where(F.col("docs") >= F.when(F.col("wide"), min_docs).otherwise(need))
        .drop("docs", "long")
    )
    # A line belongs to the finest of its templates that recurs.
    dropped = (
        named.join(recurring, ["leaf", "template", "wide"])
        .groupBy("leaf", "kind")
        .agg(F.min_by("first", "level").alias("first"))
    )
    stays = F.lit(False)
    if keep_first:
        stays = F.struct("doc", "mark", "line_no").eqNullSafe(F.col("first"))
    masks = (
        lines.join(dropped, ["leaf", "kind"])
        .where(~stays)
        .select("doc", "mark", "line_no")
        .distinct()
        .groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"))
        .agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
    )
    # The input's columns travel in a struct, so that none can clash.
    met = (
        documents.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        .join(masks, F.col("doc").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_mark")), "left")
        .withColumn("lines", F.split("text", "\n"))
    )
    cut = met.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without("lines", "gone")).alias("cut"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("all"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("less"),
    )
    others = [c for c in documents.columns if c not in (text_col, "n_lines", "n_dropped")]
    made = F.col("cut").alias(text_col), F.col("all").alias("n_lines"), F.col("less").alias("n_dropped")
    return cut.select(*(F.col("row")[c].alias(c) for c in others), *made)


def _without(lines: str, gone: str) -> Column:
    """Lines outside a sorted list of numbers, joined again.

    The runs of lines between two dropped ones are cut out as slices, so the work
    is in proportion to the lines, however many are dropped.
    """
    edges = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines)))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(gone) + 1),
        lambda i: F.slice(
            F.col(lines),
            F.get(edges, i - 1) + 2,
            F.get(edges, i) - F.get(edges, i - 1) - 1,
        ),
    )
    return F.array_join(F.flatten(runs), "\n")
