"""Replies, plans, verdicts and tables in text, parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenegrain.types import PREDICATES

# Spellings of predicates that are accepted, never other words for them.
ALIASES = {
    "to left of": "to the left of",
    "left of": "to the left of",
    "to right of": "to the right of",
    "right of": "to the right of",
    "front of": "in front of",
    "infront of": "in front of",
}
# Verbs that take hold of an object, and all that act on one.
HOLD_VERBS = r"pick(?:s|ing)?\s+up|pick|grasp\w*|grip\w*|lift\w*|grab\w*|take"
ACT_VERBS = HOLD_VERBS + r"|remove|move|slide|push|place|set|put|transfer|relocate|clear"
OBJECT_TOKEN = r"\b([a-z]+[0-9]+)\b"
STEP_MARK = r"(?m)^\s*(?:[0-9]+[.)]|[-*])\s+"


def canonical_predicate(raw: Column) -> Column:
    """The vocabulary's spelling of a predicate, null if it is another word."""
    p = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "_", " "), r"\s+", " "))
    names = F.create_map(*[F.lit(x) for kv in ({k: k for k in PREDICATES} | ALIASES).items() for x in kv])
    return names[p]


def _whole(value: Column) -> Column:
    """A JSON value as a whole number: numbers cut towards zero, true and false as 1 and 0, text only if it is a whole number."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    written = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    number = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).otherwise(F.try_variant_get(value, "$", "double").try_cast("bigint"))
    return F.when(kind == "STRING", written).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number)


def parsed_relations(df: DataFrame, reply: str, n_objects: str) -> DataFrame:
    """Every record of the JSON in a reply: s, p, o and problem (null for a good one).

    From the first brace to the last. A reply without readable JSON, or whose relations are no list, has
    one row with a problem; one without relations has none. Records are judged one by one: whatever a
    record is (text, null, a list), it is a row of its own and the others stay. The input's columns are kept.
    """
    data = df.withColumn("_body", F.regexp_extract(F.col(reply), r"(?s)\{.*\}", 0)).withColumn("_v", F.try_parse_json("_body"))
    listed = F.try_variant_get("_v", "$.relations", "variant")
    problem = F.when(F.coalesce(F.col("_body"), F.lit("")) == "", "no JSON object").when(F.col("_v").isNull(), "unreadable JSON").when(listed.isNotNull() & ~F.schema_of_variant(listed).startswith("ARRAY"), "relations is no list")
    kept = data.withColumn("_bad", problem)
    records = F.when(F.col("_bad").isNotNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.try_variant_get(listed, "$", "array<variant>"))
    rows = kept.select(*df.columns, "_bad", F.explode(records).alias("_x"))
    got = {c: F.try_variant_get("_x", f"$.{c}", "variant") for c in "spo"}
    rows = rows.withColumns({"_s": _whole(got["s"]), "_o": _whole(got["o"]), "_p": got["p"]})
    s, o, n = F.col("_s"), F.col("_o"), F.col(n_objects)
    p = canonical_predicate(F.try_variant_get("_p", "$", "string"))
    bad = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(s.isNull() | o.isNull() | F.col("_p").isNull(), "malformed record").when(p.isNull(), "unknown predicate").when((s < 0) | (o < 0) | (s >= n) | (o >= n) | (s == o), "index out of range or self-pair")
    return rows.select(*df.columns, s.try_cast("int").alias("s"), p.alias("p"), o.try_cast("int").alias("o"), bad.alias("problem"))


def verdict(reply: Column) -> Column:
    """y for TRUE, n for WRONG, the empty string for both or neither."""
    t, w = F.contains(F.upper(reply), F.lit("TRUE")), F.contains(F.upper(reply), F.lit("WRONG"))
    return F.when(t & ~w, "y").when(w & ~t, "n").otherwise("")


def plan_steps(reply: Column) -> Column:
    """Steps of a numbered plan, without what stands before the first number; lines, if there is at most one."""
    first = F.regexp_instr(reply, F.lit(STEP_MARK))
    body = F.when(first > 0, F.substring(reply, first, F.length(reply))).otherwise(reply)
    clean = lambda parts: F.filter(F.transform(parts, F.trim), lambda x: x != "")
    parts = clean(F.split(body, STEP_MARK))
    return F.when(F.size(parts) > 1, parts).otherwise(clean(F.split(body, r"\n")))


def acted_objects(step: Column, verbs: str) -> Column:
    """The first object named within 60 characters after each verb of a step."""
    tails = F.regexp_extract_all(step, F.lit(rf"(?is)\b(?:{verbs})\b(?=(.{{0,60}}))"), F.lit(1))
    return F.filter(F.transform(tails, lambda t: F.regexp_extract(t, OBJECT_TOKEN, 1)), lambda x: x != "")


def scored_plan(df: DataFrame, reply: str = "reply", target: str = "target", must_clear: str = "must_clear", allowed: str = "allowed") -> DataFrame:
    """Whether a plan grasps its target, clears what is in the way before, and invents nothing."""
    steps = df.withColumn("_s", plan_steps(F.col(reply)))
    place = lambda who, verbs: F.array_min(F.filter(F.transform("_s", lambda x, i: F.when(F.array_contains(acted_objects(x, verbs), F.col(who)), i)), lambda v: v.isNotNull()))
    steps = steps.withColumns({"grasp_step": place(target, HOLD_VERBS), "clear_step": place(must_clear, ACT_VERBS)})
    named = F.array_distinct(F.flatten(F.transform("_s", lambda x: F.regexp_extract_all(x, F.lit(OBJECT_TOKEN), F.lit(1)))))
    steps = steps.withColumn("invented", F.array_sort(F.array_except(named, F.col(allowed))))
    return steps.withColumns(
        {
            "n_steps": F.size("_s"),
            "grasps_target": F.col("grasp_step").isNotNull(),
            "mentions_clear": F.col("clear_step").isNotNull(),
            "clears_first": F.coalesce(F.col("clear_step") < F.col("grasp_step"), F.lit(False)),
            "no_invented": F.size("invented") == 0,
        }
    ).drop("_s")


def markdown_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """Cells of pipe tables, one row per line of a table; separator rows are left out."""
    cells = F.transform(F.split(F.btrim(F.trim(text), F.lit("|")), r"\|"), lambda c: F.trim(F.regexp_replace(c, r"[*`]", "")))
    return lines.where(F.trim(F.col(text)).startswith("|") & ~F.col(text).rlike(r"^\s*\|[\s:|-]+\|\s*$")).withColumn("cells", cells)


def markdown_tables(lines: DataFrame, doc: str = "doc", at: str = "at", text: str = "value") -> DataFrame:
    """Rows of all pipe tables of documents given as lines: doc, tab (from 1), row (0: header) and cells, without emphasis.

    A table is a run of lines that begin with a pipe; rulers between header and body are left out, and a
    line of anything else ends it.
    """
    in_doc = Window.partitionBy(doc).orderBy(at)
    piped = F.startswith(F.ltrim(F.col(text)), F.lit("|"))
    opens = F.col("_piped") & ~F.coalesce(F.lag("_piped").over(in_doc), F.lit(False))
    runs = lines.withColumn("_piped", F.coalesce(piped, F.lit(False))).withColumn("tab", F.sum(opens.cast("int")).over(in_doc)).where("_piped")
    cells = F.transform(F.split(F.btrim(F.trim(text), F.lit("|")), r"\|"), lambda c: F.trim(F.regexp_replace(c, r"[*`]", "")))
    rows = runs.withColumn("cells", cells).where(~F.forall("cells", lambda c: c.rlike(r"^[-: ]*$")))
    place = F.row_number().over(Window.partitionBy(doc, "tab").orderBy(at)) - 1
    return rows.select(doc, F.col("tab").cast("int").alias("tab"), place.alias("row"), "cells")


def table_cells(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """Cells of markdown_tables(): doc, tab, head (the header's cells), label (the row's first cell), col (from 0) and cell."""
    head = F.concat_ws(" | ", F.first("cells").over(Window.partitionBy(doc, "tab").orderBy("row")))
    return rows.withColumn("head", head).where("row > 0").select(doc, "tab", "head", "row", F.col("cells")[0].alias("label"), F.posexplode("cells").alias("col", "cell"))


def table_drift(quoted: DataFrame, generated: DataFrame, doc: str = "doc") -> DataFrame:
    """Cells of quoted tables that differ from those of the generated table of the same header, row label and column: doc, head, label, col, quoted and generated.

    Of several generated tables with one header the first counts, of rows with one label the last.
    """
    first = generated.groupBy("head").agg(F.min(F.struct(doc, "tab")).alias("_one")).select("head", "_one.*")
    known = generated.join(first, ["head", doc, "tab"]).groupBy("head", "label", "col").agg(F.max_by("cell", "row").alias("generated"))
    return quoted.join(known, ["head", "label", "col"]).where(F.col("cell") != F.col("generated")).select(doc, "head", "label", "col", F.col("cell").alias("quoted"), "generated")


def half_up(x: Column, places: int = 2) -> Column:
    """Half-up rounding of the number as written."""
    return F.format_string(f"%.{places}f", F.round(F.col(x) if isinstance(x, str) else x, places))


def dangling_references(lines: DataFrame, doc: str = "doc", at: str = "at", text: str = "value") -> DataFrame:
    """References `§n.m` to sections that no numbered heading of the same document has: doc, ref."""
    heads = lines.select(doc, F.regexp_extract(text, r"^#+\s+([0-9]+(?:\.[0-9]+)*)", 1).alias("ref")).where("ref <> ''").distinct()
    refs = lines.select(doc, F.explode(F.regexp_extract_all(text, F.lit(r"§\s?([0-9]+(?:\.[0-9]+)*)"), F.lit(1))).alias("ref")).distinct()
    return refs.join(heads, [doc, "ref"], "left_anti")


def drifted_cells(generated: DataFrame, quoted: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Quoted cells that differ from the generated ones: numbers by more than half a unit of the last quoted place, other text at all."""
    q = quoted.select(*keys, F.col(value).alias("quoted")).join(generated.select(*keys, F.col(value).alias("generated")), keys)
    x, y = F.expr("try_cast(quoted as double)"), F.expr("try_cast(generated as double)")
    places = F.length(F.regexp_extract("quoted", r"\.([0-9]+)$", 1))
    near = F.abs(x - y) <= F.lit(0.6) * F.pow(F.lit(10.0), -places)
    return q.where(~F.coalesce(near, F.col("quoted") == F.col("generated")))
