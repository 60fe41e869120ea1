"""Secrets in whole texts, with multipart credentials linked by an interval join.

All work is DataFrame functions. Places of matches come from splitting a text
at them: the lengths of the pieces and of the matches add up to code point
offsets.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they stand.
Weak kinds (``login``, ``credential``, ``endpoint``) are reported only if a
complementary part, base or weak, stands within ``SCOPE`` code points of them:
an identifier needs a secret, a secret an identifier or an endpoint, an endpoint
a secret. The parts of texts that hold a weak candidate are dealt to windows of
SCOPE code points and joined there, so a window holds no more parts than fit
into it, however long its text.

Defined results: a null or empty text has no spans; repeated rows are each
reported; rows with a null doc_id are kept; an empty table gives no rows; other
columns are not read, apart from those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SCOPE = 200

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak kinds.
LOGIN = r"""(?i)(username|user|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)"""
CREDENTIAL = r"""(?i)(pwd|passphrase|auth|credential|private_?key|signature)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ENDPOINT = r"""(?i)(https?|wss?|ftps?|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://([A-Za-z0-9._~%:/?#@!$&()*+,;=-]+)"""

#: kind, pattern, least length of the second group (0: the whole match counts), role.
KINDS = [
    ("assign", ASSIGN, 6, "secret"),
    ("access", ACCESS, 0, "identifier"),
    ("hex", HEX, 0, "secret"),
    ("login", LOGIN, 3, "identifier"),
    ("credential", CREDENTIAL, 8, "secret"),
    ("endpoint", ENDPOINT, 4, "endpoint"),
]
BASE = 3


def _chunked(values: Column, size: Column) -> Column:
    """values in an array of arrays of about the square root of size, so that no fold grows a long array."""
    n = F.greatest(F.lit(16), F.ceil(F.sqrt(size)).cast("int"))
    starts = F.when(size > 0, F.sequence(F.lit(1), size, n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, n))


def spans(text: Column, pattern: str, least: int) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches whose second group has at least so many characters."""
    number = lambda x: F.length(x).cast("long")
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(number(gap).alias("gap"), number(hit).alias("hit"), (F.length(F.regexp_extract(hit, pattern, 2)) >= least if least else F.lit(True)).alias("ok")),
    )
    none = F.array().cast("array<struct<start:long,end:long>>")
    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + F.coalesce(x["hit"], F.lit(0)))

    def placed(chunk: Column, first: Column) -> Column:
        """The spans of a chunk whose text begins at first."""

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.struct(start.alias("start"), (start + x["hit"]).alias("end"))
            found = F.when(x["ok"], F.array_append(acc["found"], one)).otherwise(acc["found"])
            return F.when(x["hit"].isNull(), acc).otherwise(F.struct((start + x["hit"]).alias("at"), found.alias("found")))

        return F.aggregate(chunk, F.struct(first.alias("at"), none.alias("found")), add)["found"]

    def of(parts: Column) -> Column:
        chunks = _chunked(parts, F.size(parts))

        def next_start(acc: Column, chunk: Column) -> Column:
            return F.struct((acc["at"] + total(chunk)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

        starts = F.aggregate(chunks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts")), next_start)["starts"]
        return F.flatten(F.zip_with(chunks, starts, placed))

    # a let: parts are made once
    found = F.transform(F.array(parts), of)[0]
    return F.when(text.rlike(pattern), found).otherwise(none)


def _tagged(kinds: list[int], role: bool = False) -> Column:
    """One array of (start, kind number, end) over the kinds' columns, with their role if asked for."""

    def of(i: int) -> Column:
        more = [F.lit(KINDS[i][3]).alias("role")] if role else []
        return F.transform(KINDS[i][0], lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), *more))

    return F.concat(*map(of, kinds))


def scan(docs: DataFrame) -> DataFrame:
    """Of docs(doc_id, text), written: doc_id, text_hash, and for each kind its candidate spans."""
    text = F.coalesce("text", F.lit(""))
    return written(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), *(spans(text, p, n).alias(k) for k, p, n, _ in KINDS)), "secrets")


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, and the weak spans with a complementary part in scope, as an array of (start, kind number, end)."""
    weak = [k for k, _, _, _ in KINDS[BASE:]]
    has_weak = " or ".join(f"size({k}) > 0" for k in weak)
    parts = scanned.where(has_weak).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode(_tagged([*range(len(KINDS))], role=True)).alias("p")).select("doc_id", "text_hash", "p.*")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    a = parts.where(F.col("kind") >= BASE).withColumn("bin", bins(F.col("start"), F.col("end"))).alias("a")
    b = parts.withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope)).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.bin") == F.col("b.bin"))
    near = (F.col("a.start") - F.col("b.end") <= scope) & (F.col("b.start") - F.col("a.end") <= scope)
    fits = F.when(F.col("a.role") == "secret", F.col("b.role") != "secret").otherwise(F.col("b.role") == "secret")
    hits = a.join(b, same & near & fits, "left_semi")
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "kind", "end")).alias("weak"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and spans: arrays of (start, kind number, end), in this order."""
    scanned = scan(docs)
    base = F.array_sort(_tagged([*range(BASE)]))
    left = scanned.select("doc_id", "text_hash", *(F.size(k).cast("long").alias(f"n_{k}") for k, _, _, _ in KINDS[:BASE]), base.alias("base")).alias("s")
    right = linked(scanned).alias("w")
    key = F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.text_hash") == F.col("w.text_hash"))
    return left.join(right, key, "left").select("s.*", F.when(F.col("w.weak").isNull(), F.col("s.base")).otherwise(F.array_sort(F.concat("s.base", "w.weak"))).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, _, _, _ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each stretch covered by spans of secrets replaced by mask; every row is kept, and n_chars, if there is one, follows the text."""
    found = find_secrets(docs.select("doc_id", "text")).where("size(spans) > 0").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "spans").alias("f")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).alias("r")
    joined = rows.join(found, F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash")), "left").select("row", "text", "spans")
    text = F.col("text")

    long = lambda n: F.lit(n).cast("long")

    def join_overlaps(acc: Column, s: Column) -> Column:
        """Cuts a span to what no span before it covers."""
        one = F.struct(F.greatest(s["start"], acc["at"]).alias("start"), s["end"].alias("end"), (s["start"] >= acc["at"]).alias("first"))
        more = F.when(s["end"] > acc["at"], F.array_append(acc["out"], one)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    def masked_chunk(chunk: Column, first: Column) -> Column:
        """The text from first to the chunk's last span, masked; cut out once, so that no place is sought from the text's start for each span."""
        last = F.element_at(chunk, -1)["end"]
        part = F.substring(text, (first + 1).cast("int"), (last - first).cast("int"))

        def pieces(part: Column) -> Column:
            before = F.concat(F.array(first), F.transform(chunk, lambda s: s["end"]))
            return F.array_join(F.zip_with(F.slice(before, 1, F.size(chunk)), chunk, lambda at, s: F.concat(F.substring(part, (at - first + 1).cast("int"), (s["start"] - at).cast("int")), F.when(s["first"], F.lit(mask)).otherwise(""))), "")

        return F.transform(F.array(part), pieces)[0]

    def folded(chunks: Column) -> Column:
        """Spans without overlaps, in the chunks of spans."""
        none = F.array().cast("array<struct<start:long,end:long,first:boolean>>")
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        upto = F.aggregate(ends, F.struct(long(0).alias("at"), F.array().cast("array<long>").alias("out")), lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
        return F.filter(F.zip_with(chunks, upto, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), join_overlaps)["out"]), lambda c: F.size(c) > 0)

    def whole(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.element_at(c, -1)["end"])
        starts = F.slice(F.concat(F.array(long(0)), ends), 1, F.size(chunks))
        rest = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.lit(2147483647))
        return F.concat(F.array_join(F.zip_with(chunks, starts, masked_chunk), ""), rest)

    chunks = _chunked(F.col("spans"), F.size("spans"))
    masked = F.transform(F.transform(F.array(chunks), folded), whole)[0]
    row = F.col("row").withField("text", masked)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(masked).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = ", ".join(f"({i}, '{k}', {quoted(p)}, {n}, '{r}')" for i, (k, p, n, r) in enumerate(KINDS))
    return f"""
WITH kinds(kind, name, pattern, least, role) AS (VALUES {kinds}),
cut AS (
  {" UNION ALL ".join(f"SELECT doc_id, {i} AS kind, {n} AS least, regexp_split_to_array(coalesce(text, ''), {quoted(p)}) AS gaps, regexp_extract_all(coalesce(text, ''), {quoted(p)}, 0) AS hits" + (f", regexp_extract_all(coalesce(text, ''), {quoted(p)}, 2) AS seconds" if n else ", NULL AS seconds") + " FROM documents" for i, (k, p, n, r) in enumerate(KINDS))}
), one AS (
  SELECT doc_id, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, seconds FROM cut
), placed AS (
  SELECT doc_id, kind, i, length(hits[i]) AS n, least = 0 OR length(seconds[i]) >= least AS ok,
    sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM one
), part AS (
  SELECT doc_id, kind, CAST(stop - n AS BIGINT) AS s, CAST(stop AS BIGINT) AS e, name, role FROM placed JOIN kinds USING (kind) WHERE ok
), kept AS (
  SELECT * FROM part a WHERE kind < {BASE} OR EXISTS (
    SELECT 1 FROM part b WHERE b.doc_id = a.doc_id AND a.s - b.e <= {SCOPE} AND b.s - a.e <= {SCOPE}
      AND CASE WHEN a.role = 'secret' THEN b.role <> 'secret' ELSE b.role = 'secret' END)
), listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS base,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)
"""


OP9_SQL = _sql()
