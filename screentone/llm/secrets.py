"""Secret scans: regular-expression parts of credentials, and multipart linking by interval join.

Strong parts (assignments, access ids, hex runs) stand on their own. Weak parts (a bare mixed token,
an account identifier, a service endpoint) are common in clean text; an interval join within scopes
reports them only where complementary parts co-occur nearby. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentone.llm.common import stored

#: Base kinds in their listed order: (kind, pattern, least length of the tested part).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak kinds: parts that are reported only beside complementary ones.
KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"
IDENT = r"(?<![A-Za-z0-9_])(?:user|username|account|client_id|login|key_id)\x20?[:=]\x20?[A-Za-z0-9._@-]{3,}"
ENDPOINT = r"(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@/-]+"

KINDS = ["assign", "access", "hex", "key", "ident", "endpoint"]
#: What each kind contributes to a credential.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "ident": "id", "endpoint": "endpoint"}
#: A weak part needs one of these roles within its scope.
NEEDS = {"key": ["id", "endpoint"], "ident": ["secret"], "endpoint": ["secret"]}
#: Rows of parts() with a weak part and any other.
NEEDY = "size(weak) > 0 AND size(weak) + size(base) > 1"


def _spans(text: str, kind: str, pattern: str, keep: str = "true") -> Column:
    """array<struct<start, kind_no, end>> of a pattern's matches, in code points.

    The pieces between the matches give the positions; only texts with a match are split.
    """
    p = F.lit(pattern)
    no = KINDS.index(kind)
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda piece, m: F.struct(F.length(piece).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"), m.alias("m")))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,m:string>>").alias("out"))
    walked = F.aggregate(
        parts,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(x["m"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), F.lit(no).alias("k"), (acc["at"] + x["gap"] + x["n"]).alias("e"), x["m"].alias("m")))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    empty = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    spans = F.when(F.regexp_like(text, p), walked).otherwise(empty)
    if keep != "true":
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["m"], pattern, 2)) >= 12)
    return F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"]))


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of (id, text) that no other pair shares: the id's length goes first, null ids have none."""
    i = F.col(id_col).cast("string")
    named = F.coalesce(F.concat(F.length(i).cast("string"), F.lit(":"), i), F.lit("null"))
    return F.sha2(F.concat(named, F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, base, weak): the spans of each row, map-side.

    row_key names (doc_id, text), so that rows that share a doc_id keep their own spans.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = F.array_sort(F.concat(_spans("text", "assign", ASSIGN, "group"), _spans("text", "access", ACCESS), _spans("text", "hex", HEX)))
    weak = F.concat(_spans("text", "key", KEY), _spans("text", "ident", IDENT), _spans("text", "endpoint", ENDPOINT))
    d = d.select("doc_id", "text", base.alias("base"), weak.alias("weak"))
    inside = "filter(weak, w -> NOT exists(base, b -> b.s <= w.s AND w.e <= b.e))"
    key = F.when(F.size("weak") + F.size("base") > 0, row_key("doc_id", "text"))
    return d.select("doc_id", key.alias("row_key"), "base", F.when(F.size("weak") > 0, F.expr(inside)).otherwise(F.col("weak")).alias("weak"))


def link_parts(found: DataFrame, scope: int = 256) -> DataFrame:
    """(row_key, linked): the weak spans with a complementary part at most `scope` code points away.

    A bare token that overlaps a base span is one credential with it and needs no other part.

    An interval join on (row, bucket of `scope` code points): each weak span looks into the buckets
    that its reach touches. Buckets hold at most `scope` code points of one row, so no key is hot,
    and the semi-join emits no pairs.
    """
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("p.k") + 1)
    role = F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, ROLE[k])]), kind)
    some = found.filter(NEEDY).select("row_key", "base", "weak").dropDuplicates(["row_key"])
    every = some.select("row_key", F.explode(F.concat("base", "weak")).alias("p")).select("row_key", "p.s", "p.k", "p.e", role.alias("role"))
    around = F.explode(F.sequence(F.expr(f"s div {scope}"), F.expr(f"(e - 1) div {scope}"))).alias("cell")
    right = every.select(F.col("row_key").alias("rk"), F.col("s").alias("rs"), F.col("e").alias("re"), F.col("role").alias("rr"), (F.col("k") <= KINDS.index("hex")).alias("rb"), around)
    needs = F.element_at(F.create_map(*[x for k in KINDS for x in (F.lit(k), F.array(*[F.lit(r) for r in NEEDS.get(k, [])]).cast("array<string>"))]), kind)
    left = some.select("row_key", F.explode("weak").alias("p")).select("row_key", "p.s", "p.k", "p.e", needs.alias("needs"))
    reach = F.explode(F.sequence(F.expr(f"greatest(0, s - {scope}) div {scope}"), F.expr(f"(e + {scope}) div {scope}"))).alias("cell")
    left = left.select("row_key", "s", "k", "e", "needs", reach)
    within = (F.col("rs") <= F.col("e") + scope) & (F.col("s") <= F.col("re") + scope) & F.array_contains("needs", F.col("rr"))
    across = (F.col("k") == KINDS.index("key")) & F.col("rb") & (F.col("rs") < F.col("e")) & (F.col("s") < F.col("re"))
    near = (F.col("row_key") == F.col("rk")) & (left["cell"] == right["cell"]) & (within | across)
    linked = left.join(right, near, "left_semi").select("row_key", "s", "k", "e").distinct()
    return linked.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("linked"))


def _name(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_spans(docs: DataFrame, scope: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base (spans that stand alone) and spans (with the linked weak ones).

    Spans are struct<s, k, e>: start and exclusive end in code points, k the kind's place in KINDS,
    sorted by start, then kind. Null and empty texts have none. A null doc_id stays null. Rows with
    one doc_id and different texts keep their own spans; repeated rows get equal results. Very long texts are
    searched whole; the work in a row grows with the square of its matches. An empty
    table gives an empty result; other columns are ignored.
    """
    found = stored(parts(docs, id_col, text_col), "secret-parts")
    # only rows with parts that need others take part in a join
    alone = found.filter(f"NOT ({NEEDY})").select("doc_id", "base", F.col("base").alias("spans"))
    both = found.filter(NEEDY).join(link_parts(found, scope), "row_key", "left")
    return alone.unionByName(both.select("doc_id", "base", F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked"))).alias("spans")))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_name(F.col("base")), 256).alias("base_sha256"), _name(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scope: int = 256, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every reported span replaced by `mark`; all columns and rows stay.

    Overlapping spans become one mark. length_col, if present, is set to the new length of changed
    rows. Rows without secrets, null texts among them, stay as they are; rows that share doc_id and text get equal
    results, and columns of any name stay. Very long texts are searched whole. An empty table stays empty.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # no given name can clash
    d = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    found = stored(parts(d, key, text).filter("row_key IS NOT NULL").dropDuplicates(["row_key"]), "secret-parts")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    cuts = found.join(link_parts(found, scope), "row_key", "left").select("row_key", spans.alias("spans")).filter("size(spans) > 0")
    d = d.withColumn("text", F.col(text).cast("string")).withColumn("row_key", row_key(key, text)).join(cuts.hint("merge"), "row_key", "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])))).alias("out"),
        ),
        lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1)))), mark),
    )
    changed = F.col("spans").isNotNull()
    d = d.withColumn("new", F.when(changed, cut).otherwise(F.col("text")))
    out = {c: F.col(c) for c in names}
    out[text] = F.col("new").alias(text)
    if length_col in docs.columns:
        n = names[docs.columns.index(length_col)]
        out[n] = F.when(changed, F.length("new")).otherwise(F.col(n)).cast(docs.schema[length_col].dataType).alias(n)
    return d.select(*out.values()).toDF(*docs.columns)
