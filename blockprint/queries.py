"""Queries over the test tables, and the SQL that DuckDB gives the same rows with."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprint.constants import ALPHABET, ORDERED, PARSE_ERRORS, PARSE_ORIGINS
from blockprint.functions import blocksize, digests, dual, hashes
from blockprint.operators import chunks, joins
from blockprint.plans.checkpoints import cut, shared_folder
from blockprint.plans.relational import DUCKDB, SPARK, digest_sql, trigger_counts_sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table as a stream. A table is a file or a folder of files; a stream takes either by a pattern only, as a
    plain path must be a folder and a filter of names is asked of the files inside it."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer partitions than there are (a small file of one row group); tables of many
    files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_digests(spark: SparkSession, sf_dir: str, long: bool = False) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("id"), digests.digest("text", long).alias("digest"))


def kept_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_digests() made once, for plans that use them several times."""
    return cut(document_digests(spark, sf_dir))


# ---- SQL -----------------------------------------------------------------------------------------------------------


def duck_digests(name: str, key: str, data: str, long: bool = False) -> str:
    return digest_sql(DUCKDB, name, key, data, long)


SHOWN = "concat(3 * (1 << log_block_size), ':', bh1, ':', bh2)"


def duck_normal(bh: str) -> str:
    """Runs cut to three: a character goes if the three before it are the same."""
    c = lambda k: f"substr({bh}, i - {k}, 1)"
    return f"list_aggregate(list_transform(list_filter(range(1, length({bh}) + 1), lambda i: NOT (i > 3 AND {c(0)} = {c(1)} AND {c(0)} = {c(2)} AND {c(0)} = {c(3)})), lambda i: {c(0)}), 'string_agg', '')"


def duck_keys(log: str, bh: str) -> str:
    """Index windows of a normal block hash."""
    packed = " | ".join(f"(cast(instr('{ALPHABET}', substr({bh}, i + {k}, 1)) - 1 AS bigint) << {36 - 6 * k})" for k in range(7))
    return f"list_transform(range(1, length({bh}) - 5), lambda i: (cast({log} AS bigint) << 42) | {packed})"


def duck_string_score(a: str, b: str, log: str) -> str:
    """The capped score of two block hashes: bit-parallel subsequences in 128-bit numbers, seven common characters."""
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN cast(1 AS hugeint) << cast(i - 1 AS int) ELSE cast(0 AS hugeint) END))::hugeint"
    full = "18446744073709551615::hugeint"
    steps = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask})), lambda v, m: ((v + (v & m)) & {full}) | (v & ({full} - m)))"
    lcs = f"(length({a}) - bit_count({steps} & ((cast(1 AS hugeint) << length({a})) - 1)))"
    d = f"(length({a}) + length({b}) - 2 * {lcs})"
    raw = f"(100 - (100 * (({d} * 64) // (length({a}) + length({b})))) // 64)"
    cap = f"(CASE WHEN {log} >= 4 THEN 100 ELSE (1 << least({log}, 4)) * least(length({a}), length({b})) END)"
    grams = lambda x: f"list_transform(range(1, length({x}) - 5), lambda i: substr({x}, i, 7))"
    return f"(CASE WHEN length({a}) >= 7 AND length({b}) >= 7 AND list_has_any({grams(a)}, {grams(b)}) THEN least({raw}, {cap}) ELSE 0 END)"


NORMALIZED = f"SELECT id, log_block_size AS n, coalesce({duck_normal('bh1')}, '') AS x, coalesce({duck_normal('bh2')}, '') AS y FROM d"


def duck_matches(sources: str, condition: str) -> str:
    """CTEs l and r (id, n, x, y) in sources; pairs (left_id, right_id, score) of those that meet the condition."""
    score = f"""CASE WHEN l.n = r.n AND l.x = r.x AND l.y = r.y THEN 100
  WHEN l.n = r.n THEN greatest({duck_string_score('l.x', 'r.x', 'l.n')}, {duck_string_score('l.y', 'r.y', 'l.n + 1')})
  WHEN l.n = r.n - 1 THEN {duck_string_score('l.y', 'r.x', 'r.n')}
  WHEN l.n = r.n + 1 THEN {duck_string_score('l.x', 'r.y', 'l.n')} ELSE 0 END"""
    keys = f"list_concat({duck_keys('n', 'x')}, {duck_keys('n + 1', 'y')})"
    return f"""WITH {sources},
lk AS (SELECT id, unnest({keys}) AS k FROM l), rk AS (SELECT id, unnest({keys}) AS k FROM r),
near AS (SELECT DISTINCT lk.id AS a, rk.id AS b FROM lk JOIN rk USING (k) UNION SELECT l.id, r.id FROM l JOIN r ON l.n = r.n AND l.x = r.x AND l.y = r.y),
matches AS (SELECT a AS left_id, b AS right_id, cast({score} AS int) AS score FROM near JOIN l ON l.id = a JOIN r ON r.id = b WHERE {condition})"""


DOCUMENTS = duck_digests("documents", "doc_id", "text")
ONE_SET = f"d AS ({DOCUMENTS}), l AS ({NORMALIZED}), r AS (SELECT * FROM l)"
BENCHMARK = duck_digests("benchmark", "item_id", "text")
TWO_SETS = f"d AS ({BENCHMARK}), l AS ({NORMALIZED}), d2 AS ({DOCUMENTS}), r AS ({NORMALIZED.replace('FROM d', 'FROM d2')})"
CLUSTERS = f"""{duck_matches(ONE_SET, 'true').replace('WITH', 'WITH RECURSIVE', 1)},
reach AS (SELECT id AS a, id AS b FROM l UNION SELECT reach.a, m.right_id FROM reach JOIN matches m ON m.left_id = reach.b),
named AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)"""


# ---- digests -------------------------------------------------------------------------------------------------------


@query(f"SELECT id AS doc_id, {SHOWN} AS digest FROM ({DOCUMENTS})")
def digest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(spark, sf_dir).select(F.col("id").alias("doc_id"), hashes.to_string("digest").alias("digest"))


@query(f"SELECT id AS doc_id, {SHOWN} AS digest FROM ({duck_digests('documents', 'doc_id', 'text', long=True)})")
def digest_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(spark, sf_dir, long=True).select(F.col("id").alias("doc_id"), hashes.to_string("digest").alias("digest"))


@query(f"SELECT id AS page_id, {SHOWN} AS digest FROM ({duck_digests('pages', 'page_id', 'html')})")
def digest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", hashes.to_string(digests.digest("html")).alias("digest"))


@query(f"SELECT id AS doc_id, {SHOWN} AS digest FROM ({DOCUMENTS})")
def digest_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest without a kernel, as windows and folds."""
    rows = spark.sql(digest_sql(SPARK, "{source}", "doc_id", "text"), source=spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    h = F.struct("log_block_size", "bh1", "bh2")
    return rows.select(F.col("id").alias("doc_id"), hashes.to_string(h).alias("digest"))


@query(f"SELECT log_block_size, count(*) AS n, cast(sum(length(bh1)) AS bigint) AS bh1_chars, cast(sum(length(bh2)) AS bigint) AS bh2_chars FROM ({DOCUMENTS}) GROUP BY log_block_size")
def digest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.by_block_size(document_digests(spark, sf_dir))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, octet_length(encode(text)) < 4097 AS small_input, cast(ceil(log2(greatest(1, ceil(octet_length(encode(text)) / 192)))) AS int) AS first_log FROM documents")
def small_input_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), blocksize.is_small_input(n).alias("small_input"), blocksize.log_for_input_size(n).alias("first_log"))


@query(f"SELECT id AS doc_id, level, pieces FROM ({trigger_counts_sql(DUCKDB, 'documents', 'doc_id', 'text')})")
def trigger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(digests.piece_counts("text")).alias("level", "pieces"))


@query(f"SELECT id AS conv_id, {SHOWN} AS digest FROM ({duck_digests('(SELECT conv_id, string_agg(text, chr(0)[1:0] ORDER BY turn) AS data FROM conversations GROUP BY conv_id)', 'conv_id', 'data')})".replace("chr(0)[1:0]", "''"))
def chunked_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as the chunks of one stream of bytes."""
    out = chunks.digest_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select(F.col("id").alias("conv_id"), hashes.to_string("digest").alias("digest"))


@query(f"SELECT cast(id AS varchar) AS id, {SHOWN} AS digest FROM ({DOCUMENTS})")
def streamed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a record of a stream that is read to its end."""
    from blockprint.streaming.digests import digest_records

    stream = streamed_table(spark, sf_dir, "documents")
    out = digest_records(stream, "text").select(F.col("doc_id").cast("string").alias("id"), hashes.to_string("digest").alias("digest"))
    folder = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


# ---- digests as values ---------------------------------------------------------------------------------------------

#: Parts of digest strings; all their combinations are parsed.
SIZES = ("", "0", "03", "3", "4", "96", "97", "3145728", str(3 << 30), str(3 << 31), str((1 << 32) - 1), str(1 << 32), "9" * 12, "9" * 5000, "3x", "x")
LENGTHS_1, LENGTHS_2 = (0, 1, 40, 64, 65), (0, 1, 32, 33, 64)
SEPARATORS, TAILS = (":", "", "@"), ("", ",", ',"a,b"', ":", " ")
TEXTS = [f"{size}:{(ALPHABET * 2)[:n]}{sep}{(ALPHABET * 2)[:m]}{tail}" for size in SIZES for n in LENGTHS_1 for sep in SEPARATORS for m in LENGTHS_2 for tail in TAILS]


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def duck_values(rows: tuple, names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS v({names})"


def duck_list(values: tuple) -> str:
    return "unnest([" + ", ".join(map(_literal, values)) + "])"


GRAMMAR = f"""SELECT concat(size, ':', substr(repeat('{ALPHABET}', 2), 1, n), sep, substr(repeat('{ALPHABET}', 2), 1, m), tail) AS text FROM (SELECT {duck_list(SIZES)} AS size)
CROSS JOIN (SELECT {duck_list(LENGTHS_1)} AS n) CROSS JOIN (SELECT {duck_list(SEPARATORS)} AS sep) CROSS JOIN (SELECT {duck_list(LENGTHS_2)} AS m) CROSS JOIN (SELECT {duck_list(TAILS)} AS tail)"""


def duck_parsed(strict: bool, most: int = 32) -> str:
    """text, kind, origin, place (of the error, or the end) of raw digests in CTE t. Strict parsers say that a block hash is
    too long where more than an end follows a full one."""
    run = lambda x: f"regexp_extract({x}, '^[A-Za-z0-9+/]*')"
    too_long = lambda bh, after, n: f"length({bh}) > {n}" + f" OR length({bh}) = {n} AND {after} NOT IN ('', ':', ',')" * strict
    return f"""p AS (SELECT text, regexp_extract(text, '^[0-9]*') AS d FROM t), q AS (SELECT *, length(d) AS n, substr(text, length(d) + 1, 1) AS c, try_cast(d AS bigint) AS size, substr(text, length(d) + 2) AS r1 FROM p),
x AS (SELECT *, {run('r1')} AS bh1 FROM q), y AS (SELECT *, substr(r1, length(bh1) + 1, 1) AS c1, substr(r1, length(bh1) + 2) AS r2 FROM x), z AS (SELECT *, {run('r2')} AS bh2 FROM y), w AS (SELECT *, substr(r2, length(bh2) + 1, 1) AS c2 FROM z),
e AS (SELECT *, CASE WHEN d LIKE '0%' THEN ['BlockSizeStartsWithZero', 'BlockSize', '0'] WHEN c = '' THEN ['UnexpectedEndOfString', 'BlockSize', cast(n AS varchar)] WHEN c <> ':' THEN ['UnexpectedCharacter', 'BlockSize', cast(n AS varchar)] WHEN n = 0 THEN ['BlockSizeIsEmpty', 'BlockSize', '0']
WHEN n > 10 OR size > 4294967295 THEN ['BlockSizeIsTooLarge', 'BlockSize', '0'] WHEN size % 3 <> 0 OR bit_count(size // 3) <> 1 OR size // 3 > 1073741824 THEN ['BlockSizeIsInvalid', 'BlockSize', '0']
WHEN {too_long('bh1', 'c1', 64)} THEN ['BlockHashIsTooLong', 'BlockHash1', cast(n + 1 + 64 AS varchar)] WHEN c1 = '' THEN ['UnexpectedEndOfString', 'BlockHash1', cast(n + 1 + length(bh1) AS varchar)] WHEN c1 <> ':' THEN ['UnexpectedCharacter', 'BlockHash1', cast(n + 1 + length(bh1) AS varchar)]
WHEN {too_long('bh2', 'c2', most)} THEN ['BlockHashIsTooLong', 'BlockHash2', cast(n + 2 + length(bh1) + {most} AS varchar)] WHEN c2 NOT IN ('', ',') THEN ['UnexpectedCharacter', 'BlockHash2', cast(n + 2 + length(bh1) + length(bh2) AS varchar)] END AS error FROM w)
SELECT text, error[1] AS kind, error[2] AS origin, cast(coalesce(cast(error[3] AS int), n + 2 + length(bh1) + length(bh2)) AS int) AS place"""


def grammar_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


@query(f"WITH t AS ({GRAMMAR}), {duck_parsed(False)} FROM e")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = hashes.parse("text", normalized=False)
    rows = grammar_texts(spark).select("text", p.alias("p"))
    return rows.select("text", F.col("p.error.kind").alias("kind"), F.col("p.error.origin").alias("origin"), F.coalesce("p.error.offset", "p.last_index").alias("place"))


@query(f"WITH t AS ({GRAMMAR}), {duck_parsed(True, 64)}, CASE WHEN error IS NULL AND c2 = ',' THEN regexp_replace(substr(r2, length(bh2) + 2), '^\"(.*)\"$', '\\1') END AS file_name FROM e")
def parse_long_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long raw digests by the strict parser, with the names that follow them."""
    p = hashes.parse("text", long=True, normalized=False, strict=True)
    rows = grammar_texts(spark).select("text", p.alias("p"))
    return rows.select("text", F.col("p.error.kind").alias("kind"), F.col("p.error.origin").alias("origin"), F.coalesce("p.error.offset", "p.last_index").alias("place"), F.col("p.file_name").alias("file_name"))


@query(
    f"""SELECT id AS doc_id, text, CASE WHEN length(c) > 0 THEN 'BlockHashIsTooLong' END AS kind, CASE WHEN length(c) > 0 THEN cast(length(head) + 64 AS int) END AS place, CASE WHEN length(coalesce({duck_normal('run')}, '')) > 64 THEN 'BlockHashIsTooLong' END AS lax_kind
FROM (SELECT *, concat(head, run, ':', bh2) AS text FROM (SELECT id, concat(3 * (1 << log_block_size), ':') AS head, bh2, right(bh1, 1) AS c, concat(bh1, repeat(right(bh1, 1), 70)) AS run FROM ({DOCUMENTS})))"""
)
def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that only a parser of normal forms has room for: the strict one has not."""
    rows = document_digests(spark, sf_dir).select("id", "digest")
    run = F.repeat(F.right(F.col("digest.bh1"), F.lit(1)), 70)
    rows = rows.select("id", F.concat(hashes.block_size("digest").cast("string"), F.lit(":"), F.col("digest.bh1"), run, F.lit(":"), F.col("digest.bh2")).alias("text"))
    rows = rows.select("id", "text", hashes.parse("text", strict=True)["error"].alias("e"), hashes.parse("text")["error"].alias("lax"))
    return rows.select(F.col("id").alias("doc_id"), "text", F.col("e.kind").alias("kind"), F.col("e.offset").alias("place"), F.col("lax.kind").alias("lax_kind"))


def _told(names: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {_literal(v)}" for k, v in names.items()) + " END"


@query(f"WITH t AS ({GRAMMAR}), {duck_parsed(False)} FROM e) SELECT text, concat('error occurred while parsing a fuzzy hash (', {_told(PARSE_ORIGINS, 'origin')}, ', at byte offset ', place, '): ', {_told(PARSE_ERRORS, 'kind')}) AS message FROM told WHERE kind IS NOT NULL".replace("SELECT text, error[1]", ", told AS (SELECT text, error[1]"))
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashes.with_parsed(grammar_texts(spark), "text", "p", normalized=False)
    return rows.where("p.error is not null").select("text", hashes.error_message("p.error").alias("message"))


@query(f"SELECT cast(i AS int) AS code, cast(CASE WHEN i > 0 AND instr('{ALPHABET}', chr(cast(i AS int))) > 0 THEN instr('{ALPHABET}', chr(cast(i AS int))) - 1 ELSE 64 END AS int) AS value FROM (SELECT unnest(range(1, 300)) AS i)")
def base64_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 300).select(F.col("id").cast("int").alias("code"))
    return rows.select("code", hashes.base64_index(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8")).alias("value"))


@query(
    f"""SELECT id AS doc_id, {SHOWN} AS made, {SHOWN} AS made_of_size, CASE WHEN length(bh2) <= 32 THEN {SHOWN} END AS short, CASE WHEN length(bh2) > 32 THEN 'BlockHashOverflow' END AS error, '3::' AS none, true AS refused,
cast(list_sum(list_transform(string_split(bh1, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE instr('{ALPHABET}', c) - 1 END)) AS bigint) AS code_sum, concat('{{"log_block_size":', log_block_size, ',"bh1":"', bh1, '","bh2":"', bh2, '"}}') AS debug FROM ({duck_digests('documents', 'doc_id', 'text', long=True)})"""
)
def constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_digests(spark, sf_dir, long=True).select("id", "digest.*", "digest")
    made = hashes.digest("log_block_size", "bh1", "bh2")
    refused = hashes.digest(F.lit(31), F.lit(""), F.lit("")).isNull() & hashes.digest(F.lit(0), F.lit("a-"), F.lit("")).isNull() & hashes.from_block_size(F.lit(5), F.lit(""), F.lit("")).isNull()
    rows = rows.select(
        F.col("id").alias("doc_id"),
        hashes.to_string(made).alias("made"),
        hashes.to_string(hashes.from_block_size(hashes.block_size("digest"), "bh1", "bh2")).alias("made_of_size"),
        hashes.to_short("digest").alias("s"),
        hashes.to_string(hashes.empty()).alias("none"),
        refused.alias("refused"),
        F.aggregate(hashes.codes("bh1"), F.lit(0).cast("long"), lambda n, c: n + c).alias("code_sum"),
        hashes.debug("digest").alias("debug"),
    )
    return rows.select("doc_id", "made", "made_of_size", hashes.to_string("s.hash").alias("short"), F.col("s.error").alias("error"), "none", "refused", "code_sum", "debug")


@query(f"SELECT a.id AS doc_id, CASE a.log_block_size - b.log_block_size WHEN -1 THEN 'NearLt' WHEN 0 THEN 'NearEq' WHEN 1 THEN 'NearGt' ELSE 'Far' END AS relation, a.log_block_size = b.log_block_size AS eq, b.log_block_size - a.log_block_size = 1 AS lt, a.log_block_size - b.log_block_size = 1 AS gt FROM ({DOCUMENTS}) a JOIN ({DOCUMENTS}) b ON b.id = a.id + 1")
def hash_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each digest against the next document's."""
    rows = kept_digests(spark, sf_dir)
    both = rows.select("id", F.col("digest").alias("a")).join(rows.select((F.col("id") - 1).alias("id"), F.col("digest").alias("b")), "id")
    n, m = F.col("a.log_block_size"), F.col("b.log_block_size")
    return both.select(F.col("id").alias("doc_id"), hashes.compare_block_sizes("a", "b").alias("relation"), blocksize.is_near_eq(n, m).alias("eq"), blocksize.is_near_lt(n, m).alias("lt"), blocksize.is_near_gt(n, m).alias("gt"))


@query(f"SELECT id AS doc_id, cast(3 * (1 << log_block_size) AS bigint) AS block_size, bh1, bh2, length(bh1) AS len1, length(bh2) AS len2, length({SHOWN}) AS len_in_str, length({SHOWN}) AS last_index FROM ({DOCUMENTS})")
def parse_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_digests(spark, sf_dir).select("id", hashes.to_string("digest").alias("text"))
    rows = hashes.with_parsed(rows, "text", "p", normalized=False)
    h = F.col("p.hash")
    lengths = [F.length(h["bh1"]).alias("len1"), F.length(h["bh2"]).alias("len2"), hashes.length_as_string(h).alias("len_in_str")]
    return rows.select(F.col("id").alias("doc_id"), hashes.block_size(h).alias("block_size"), h["bh1"].alias("bh1"), h["bh2"].alias("bh2"), *lengths, F.col("p.last_index").alias("last_index"))


@query(f"WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}) SELECT d.id AS doc_id, concat(3 * (1 << n), ':', x, ':', y) AS normal, d.bh1 = l.x AND d.bh2 = l.y AS was_normal, true AS valid FROM d JOIN l ON d.id = l.id")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_digests(spark, sf_dir)
    return rows.select(F.col("id").alias("doc_id"), hashes.to_string(hashes.normalize("digest")).alias("normal"), hashes.is_normalized("digest").alias("was_normal"), hashes.is_valid(hashes.normalize("digest"), normalized=True).alias("valid"))


@query(
    """SELECT cast(n AS int) AS n, n % 3 = 0 AND n > 0 AND bit_count(n // 3) = 1 AS valid_size, CASE WHEN n % 3 = 0 AND n > 0 AND bit_count(n // 3) = 1 THEN cast(log2(n // 3) AS int) ELSE -1 END AS log_of_size,
    n < 31 AS valid_log, CASE WHEN n < 31 THEN 3 * (cast(1 AS bigint) << n) ELSE -1 END AS size_of_log, 192 * (cast(1 AS bigint) << least(n, 30)) AS preferred FROM (SELECT unnest(range(0, 200)) AS n)"""
)
def block_size_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = spark.range(0, 200).select(F.col("id").cast("int").alias("n"))
    return rows.select("n", blocksize.is_valid(n).alias("valid_size"), F.coalesce(blocksize.log_of(n), F.lit(-1)).alias("log_of_size"), blocksize.is_log_valid(n).alias("valid_log"), F.coalesce(blocksize.from_log(n), F.lit(-1)).alias("size_of_log"), blocksize.preferred_input_size(F.least(n, F.lit(30))).alias("preferred"))


@query("SELECT cast(a AS int) AS a, cast(b AS int) AS b, CASE a - b WHEN -1 THEN 'NearLt' WHEN 0 THEN 'NearEq' WHEN 1 THEN 'NearGt' ELSE 'Far' END AS relation, abs(a - b) <= 1 AS near, cast(sign(a - b) AS int) AS compared FROM (SELECT unnest(range(0, 31)) AS a) CROSS JOIN (SELECT unnest(range(0, 31)) AS b)")
def block_size_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(0, 31).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("b"))
    return one.select("a", "b", blocksize.relation("a", "b").alias("relation"), blocksize.is_near("a", "b").alias("near"), blocksize.compare("a", "b").alias("compared"))


@query(f"WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}) SELECT DISTINCT id AS doc_id, unnest(list_concat({duck_keys('n', 'x')}, {duck_keys('n + 1', 'y')})) AS key FROM l")
def index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(hashes.index_keys(hashes.normalize("digest"))).alias("key"))


@query(f"WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}) SELECT id AS doc_id, i AS place, substr(x, cast(i AS int), 7) AS gram, list_extract({duck_keys('0', 'x')}, i) AS number FROM (SELECT id, x, unnest(range(1, length(x) - 5)) AS i FROM l)")
def numeric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_digests(spark, sf_dir).select(F.col("id").alias("doc_id"), hashes.normalize("digest")["bh1"].alias("b"))
    both = F.arrays_zip(hashes.windows("b").alias("gram"), hashes.numeric_windows("b").alias("number"))
    rows = rows.select("doc_id", F.posexplode(both).alias("p", "z"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("place"), F.col("z.gram").alias("gram"), F.col("z.number").alias("number"))


@query(
    f"""SELECT id AS doc_id, row_number() OVER (ORDER BY log_block_size, rpad(translate(bh1, '{ALPHABET}', '{ORDERED}'), 64, '0') COLLATE "C", length(bh1), rpad(translate(bh2, '{ALPHABET}', '{ORDERED}'), 64, '0') COLLATE "C", length(bh2), id) AS place FROM ({DOCUMENTS})""".replace(' COLLATE "C"', "")
)
def order_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each digest in their order: sorted in ranges over the cluster, then numbered by the ranges' sizes."""
    rows = document_digests(spark, sf_dir).select("id", hashes.sort_key("digest").alias("key"))
    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    ordered = cut(ordered)
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(sizes.select("part", "first", before.alias("before")), "part").select(F.col("id").alias("doc_id"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("place"))


@query(f"WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}) SELECT d.id AS doc_id, {SHOWN} AS raw, concat(3 * (1 << n), ':', x, ':', y) AS normal, true AS valid FROM d JOIN l ON d.id = l.id")
def dual_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_digests(spark, sf_dir).select("id", dual.compress("digest").alias("dual"))
    return rows.select(F.col("id").alias("doc_id"), dual.to_raw_string("dual").alias("raw"), dual.to_normalized_string("dual").alias("normal"), dual.is_valid("dual").alias("valid"))


# ---- comparison ----------------------------------------------------------------------------------------------------

SIX = "6144:SIsMYod+X3oI+YnsMYod+X3oI+YZsMYod+X3oI+YLsMYod+X3oI+YQ:Z5d+X395d+X3X5d+X315d+X3+"
THREE = "3072:S+IiyfkMY+BES09JXAnyrZalI+YuyfkMY+BES09JXAnyrZalI+YQ:S+InsMYod+X3oI+YLsMYod+X3oI+YQ"
TWELVE = "12288:Z5d+X3pz5d+X3985d+X3X5d+X315d+X3+:1+Jr+d++H+5+e"
#: Published digests and their scores; errors as side and kind.
SCORED = (
    ("6:3ll7QzDkmJmMHkQoO/llSZEnEuLszmbMAWn:VqDk5QtLbW", "6:3ll7QzDkmQjmMoDHglHOxPWT0lT0lT0lB:VqDk+n", 46, None, None),
    ("12288:+ySwl5P+C5IxJ845HYV5sxOH/cccccccei:+Klhav84a5sxJ", "12288:+yUwldx+C5IxJ845HYV5sxOH/cccccccex:+glvav84a5sxK", 88, None, None),
    (SIX, "6144:SAsMYod+X3oI+YEWnnsMYod+X3oI+Y5sMYod+X3oI+YLsMYod+X3oI+YQ:H5d+X36WnL5d+X3v5d+X315d+X3+", 94, None, None),
    (THREE, SIX, 72, None, None),
    (SIX, TWELVE, 88, None, None),
    (THREE, TWELVE, 0, None, None),
    ("3::", "3::", 100, None, None),
    ("3::", "6::", 0, None, None),
    ("", "3::", None, "Left", "UnexpectedEndOfString"),
    ("3::", "4::", None, "Right", "BlockSizeIsInvalid"),
    ("3:", "4::", None, "Left", "UnexpectedEndOfString"),
)


@query(duck_values(tuple((a, b, -1 if s is None else s, *e) for a, b, s, *e in SCORED), "lhs, rhs, score, side, kind"))
def compare_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in SCORED], "lhs string, rhs string").select("lhs", "rhs", digests.compare("lhs", "rhs").alias("c"))
    return rows.select("lhs", "rhs", F.coalesce("c.score", F.lit(-1)).alias("score"), F.col("c.side").alias("side"), F.col("c.error.kind").alias("kind"))


@query(f"{duck_matches(ONE_SET, 'l.id < r.id')} SELECT left_id, right_id FROM matches JOIN l ON l.id = left_id JOIN r ON r.id = right_id WHERE NOT (l.n = r.n AND l.x = r.x AND l.y = r.y) OR length(l.x) >= 7 OR length(l.y) >= 7")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.candidate_pairs(kept_digests(spark, sf_dir)).toDF("left_id", "right_id")


@query(f"{duck_matches(ONE_SET, 'l.id < r.id')} SELECT left_id, right_id, score FROM matches WHERE score >= 40")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.similarity_join(kept_digests(spark, sf_dir), threshold=40).toDF("left_id", "right_id", "score")


@query(f"{duck_matches(ONE_SET, 'l.id <> r.id')} SELECT left_id, right_id, score, cast(row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS int) AS place FROM matches QUALIFY place <= 3")
def topk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_digests(spark, sf_dir)
    return joins.top_matches(rows, rows, 3).toDF("left_id", "right_id", "score", "place")


@query(f"{duck_matches(TWO_SETS, 'true')} SELECT left_id AS item_id, right_id AS doc_id, score FROM matches WHERE score >= 1")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), digests.digest("text").alias("digest"))
    return joins.one_against_many(items, kept_digests(spark, sf_dir)).toDF("item_id", "doc_id", "score")


@query(f"{duck_matches(TWO_SETS, 'true')} SELECT DISTINCT right_id AS doc_id FROM matches WHERE score >= 1")
def documents_with_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(digests.digest("text").alias("digest"))
    return joins.with_match(kept_digests(spark, sf_dir), items).select(F.col("id").alias("doc_id"))


@query(f"{duck_matches(TWO_SETS, 'true')} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT right_id FROM matches WHERE score >= 1)")
def documents_without_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(digests.digest("text").alias("digest"))
    return joins.with_match(kept_digests(spark, sf_dir), items, negate=True).select(F.col("id").alias("doc_id"))


@query(f"WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}) SELECT concat(3 * (1 << n), ':', x, ':', y) AS digest, min(id) AS first_id, count(*) AS n_documents FROM l GROUP BY n, x, y HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashes.normalize("digest")
    return document_digests(spark, sf_dir).groupBy(hashes.to_string(h).alias("digest")).agg(F.min("id").alias("first_id"), F.count("*").alias("n_documents")).where("n_documents > 1")


@query(f"{CLUSTERS} SELECT id AS doc_id, cluster FROM named")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.clusters(kept_digests(spark, sf_dir)).toDF("doc_id", "cluster")


@query(f"{CLUSTERS} SELECT cluster, count(*) AS labelled, cast(sum(quality) AS bigint) AS good FROM named JOIN labels ON id = doc_id GROUP BY cluster")
def quality_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = joins.clusters(kept_digests(spark, sf_dir))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return named.join(labels, F.col("id") == F.col("doc_id")).groupBy("cluster").agg(F.count("*").alias("labelled"), F.sum("quality").alias("good"))


# ---- parts of scores, sets, duals, lists, chunks, SQL functions ----------------------------------------------------------


def duck_distance(a: str, b: str) -> str:
    """Insertions and deletions between two block hashes."""
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN cast(1 AS hugeint) << cast(i - 1 AS int) ELSE cast(0 AS hugeint) END))::hugeint"
    full = "18446744073709551615::hugeint"
    masks = f"list_transform(list_filter(string_split({b}, ''), lambda c: c <> ''), lambda c: coalesce({mask}, 0::hugeint))"
    steps = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) & {full}) | (v & ({full} - m)))"
    return f"cast(length({a}) + length({b}) - 2 * (length({a}) - bit_count({steps} & ((cast(1 AS hugeint) << length({a})) - 1))) AS int)"


NEXT = f"WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}), p AS (SELECT l.id, l.n AS n, l.x AS x, r.x AS y FROM l JOIN l r ON r.id = l.id + 1)"
GRAMS = lambda x: f"list_transform(range(1, length({x}) - 5), lambda i: substr({x}, i, 7))"


@query(
    f"""{NEXT}, q AS (SELECT *, {duck_distance('x', 'y')} AS distance, length(x) >= 7 AND length(y) >= 7 AND list_has_any({GRAMS('x')}, {GRAMS('y')}) AS common FROM p)
SELECT id AS doc_id, distance, common, CASE WHEN length(x) + length(y) > 0 THEN cast(100 - (100 * ((distance * 64) // (length(x) + length(y)))) // 64 AS int) END AS raw,
cast(CASE WHEN n >= 4 THEN 100 ELSE (1 << least(n, 4)) * least(length(x), length(y)) END AS int) AS cap,
cast(CASE WHEN common THEN 100 - (100 * ((distance * 64) // (length(x) + length(y)))) // 64 ELSE 0 END AS int) AS score,
cast(CASE WHEN common THEN least(100 - (100 * ((distance * 64) // (length(x) + length(y)))) // 64, CASE WHEN n >= 4 THEN 100 ELSE (1 << least(n, 4)) * least(length(x), length(y)) END) ELSE 0 END AS int) AS capped FROM q"""
)
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block hash of each document against the next one's."""
    rows = cut(document_digests(spark, sf_dir).select("id", hashes.normalize("digest").alias("h")))
    p = rows.select("id", F.col("h.log_block_size").alias("n"), F.col("h.bh1").alias("x")).join(rows.select((F.col("id") - 1).alias("id"), F.col("h.bh1").alias("y")), "id")
    p = p.withColumn("distance", digests.edit_distance("x", "y"))
    both = F.length("x") + F.length("y")
    return p.select(
        F.col("id").alias("doc_id"),
        "distance",
        digests.has_common_substring("x", "y").alias("common"),
        F.when(both > 0, digests.raw_score_by_distance(F.length("x"), F.greatest(F.length("y"), F.lit(1) - F.length("x")), "distance")).alias("raw"),
        digests.score_cap("n", F.length("x"), F.length("y")).alias("cap"),
        digests.string_score("x", "y").alias("score"),
        digests.string_score("x", "y", "n").alias("capped"),
    )


@query(f"{NEXT} SELECT id AS doc_id, {duck_distance('x', 'y')} AS distance FROM p")
def edit_distance_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances as plain expressions."""
    rows = document_digests(spark, sf_dir).select("id", hashes.normalize_block_hash("digest.bh1").alias("x"))
    rows = cut(rows)
    both = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    return both.select(F.col("id").alias("doc_id"), digests.edit_distance_native("x", "y").alias("distance"))


@query(f"SELECT id AS doc_id, cast(c AS int) AS code, cast(list_sum(list_transform(range(1, length(bh1) + 1), lambda i: CASE WHEN substr(bh1, i, 1) = substr('{ALPHABET}', c + 1, 1) THEN cast(1 AS hugeint) << cast(i - 1 AS int) ELSE 0::hugeint END)) AS varchar) AS places FROM ({DOCUMENTS}), (SELECT unnest(range(0, 64)) AS c) WHERE contains(bh1, substr('{ALPHABET}', c + 1, 1))".replace("unnest(range(0, 64)) AS c", "cast(unnest(range(0, 64)) AS int) AS c"))
def position_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_digests(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode(digests.position_array("digest.bh1")).alias("code", "bits")).where("bits <> 0")
    unsigned = F.col("bits").cast("decimal(20,0)") + F.when(F.col("bits") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    return rows.select("doc_id", "code", unsigned.cast("decimal(20,0)").cast("string").alias("places"))


SETS = f"d AS ({DOCUMENTS}), l AS ({NORMALIZED}), d2 AS ({BENCHMARK}), r AS ({NORMALIZED.replace('FROM d', 'FROM d2')}), a AS (SELECT concat(3 * (1 << n), ':', x, ':', y) AS digest FROM l), b AS (SELECT concat(3 * (1 << n), ':', x, ':', y) AS digest FROM r UNION ALL SELECT digest FROM (SELECT digest FROM a ORDER BY digest LIMIT 5))"


@query(f"WITH {SETS} SELECT 'union' AS kind, digest FROM (SELECT digest FROM a UNION SELECT digest FROM b) UNION ALL SELECT 'intersect', digest FROM (SELECT digest FROM a INTERSECT SELECT digest FROM b) UNION ALL SELECT 'subtract', digest FROM (SELECT digest FROM a EXCEPT SELECT digest FROM b) UNION ALL SELECT 'distinct', digest FROM (SELECT DISTINCT digest FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' digests against those of benchmark items and the first five of documents."""
    from blockprint.operators import sets

    a = kept_digests(spark, sf_dir).select("digest")
    few = a.select(hashes.normalize("digest").alias("digest")).orderBy(hashes.to_string("digest")).limit(5)  # the query's own definition of a small set
    b = cut(table(spark, sf_dir, "benchmark").select(digests.digest("text").alias("digest")).union(few))
    found = (("union", sets.union(a, b)), ("intersect", sets.intersect(a, b)), ("subtract", sets.subtract(a, b)), ("distinct", sets.distinct(b)))
    return functools.reduce(DataFrame.union, [df.select(F.lit(kind).alias("kind"), hashes.to_string("digest").alias("digest")) for kind, df in found])


@query(
    f"""WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}) SELECT d.id AS doc_id, concat(3 * (1 << n), ':', x, ':', y) AS normal, {SHOWN} AS parsed_raw, true AS equal, d.bh1 = l.x AND d.bh2 = l.y AS was_normal, true AS flat, concat(3 * (1 << n), ':', x, ':', y) AS flat_raw, 16 AS room_1, 8 AS room_2,
CAST(NULL AS varchar) AS error FROM d JOIN l ON d.id = l.id"""
)
def dual_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duals of parsed strings, without their run lengths, from normal forms, and their fields."""
    rows = document_digests(spark, sf_dir).select("id", "digest", hashes.to_string("digest").alias("text"))
    rows = rows.select("id", "digest", F.explode(F.array(dual.parse("text"))).alias("p")).select("id", "digest", "p.error", F.col("p.dual").alias("dual"))
    flat = dual.normalize("dual")
    return rows.select(
        F.col("id").alias("doc_id"),
        hashes.to_string("dual.norm").alias("normal"),
        dual.to_raw_string("dual").alias("parsed_raw"),
        (F.col("dual") == dual.compress("digest")).alias("equal"),
        dual.is_normalized("dual").alias("was_normal"),
        (dual.is_normalized(flat) & (flat == dual.from_normalized(hashes.normalize("digest")))).alias("flat"),
        dual.to_raw_string(flat).alias("flat_raw"),
        F.octet_length("dual.rle1").alias("room_1"),
        F.octet_length("dual.rle2").alias("room_2"),
        F.col("error.kind").alias("error"),
    )


@query(f"SELECT cast(id AS varchar) AS file_name, {SHOWN} AS digest FROM ({DOCUMENTS})")
def hash_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests written as a list with names and read back."""
    from blockprint.sources import files

    folder = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    files.write_hashes(document_digests(spark, sf_dir).withColumn("name", F.col("id").cast("string")), folder, file_name="name")
    return files.read_hashes(spark, folder).where("error is null").select("file_name", hashes.to_string("digest").alias("digest"))


@query(f"SELECT concat('item-', id) AS name, how, cast(octet_length(encode(text)) AS bigint) AS length, {SHOWN} AS digest, CAST(NULL AS varchar) AS error FROM ({BENCHMARK}) JOIN benchmark ON item_id = id CROSS JOIN (SELECT unnest(['whole', 'pieces']) AS how)")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written to a file each and digested from these, as a whole and in pieces."""
    from blockprint.sources import files

    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("name"), "text")
    names = files.write_files(items, folder, "name", "text")
    whole = files.hash_files(spark, folder).withColumn("how", F.lit("whole"))
    parts = files.hash_large_files(names, "path", buffer=1000).withColumn("how", F.lit("pieces"))
    return whole.unionByName(parts).select(F.element_at(F.split("path", "/"), -1).alias("name"), "how", "length", hashes.to_string("digest").alias("digest"), "error")


PREFIXES = "(SELECT concat(conv_id, '/', turn) AS id, (SELECT string_agg(text, '' ORDER BY turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn) AS data FROM conversations a)"


@query(f"SELECT id, {SHOWN} AS digest FROM ({duck_digests(PREFIXES, 'id', 'data')})")
def prefix_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each conversation up to each of its turns, from a state that goes on."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = rows.select("conv_id", "turn", place.cast("long").alias("place"))
    out = chunks.prefix_digests(rows, "conv_id", "turn", "text").withColumnRenamed("id", "conv_id").join(turns, ["conv_id", "place"])
    return out.select(F.concat_ws("/", "conv_id", "turn").alias("id"), hashes.to_string("digest").alias("digest"))


@query(f"SELECT cast(id AS varchar) AS id, {SHOWN} AS digest FROM ({duck_digests('(SELECT conv_id, string_agg(text, chr(0)[1:0] ORDER BY turn) AS data FROM conversations GROUP BY conv_id)', 'conv_id', 'data')})".replace("chr(0)[1:0]", "''"))
def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of chunks that Structured Streaming reads and keeps in its state."""
    from blockprint.streaming.digests import digest_chunks as streamed

    folder = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), (F.row_number().over(by) - 1).cast("long").alias("seq"), F.col("text").cast("binary").alias("chunk"), F.lead("turn").over(by).isNull().alias("is_last"))
    rows.write.parquet(f"{folder}/in")
    out = streamed(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).where("complete")
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{folder}/rows")
    return found.select("id", hashes.to_string(F.struct("log_block_size", "bh1", "bh2")).alias("digest"))


@query(f"{duck_matches(TWO_SETS, 'true')} SELECT right_id AS doc_id, left_id AS item_id, score FROM matches WHERE score >= 1")
def streamed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stream past the benchmark's digests."""
    from blockprint.streaming.digests import match_records

    folder = f"{shared_folder(spark)}/matches-{uuid.uuid4().hex}"
    known = cut(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), digests.digest("text").alias("digest")))
    stream = streamed_table(spark, sf_dir, "documents")
    out = match_records(stream, known, "text", "doc_id")
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows").select(F.col("id").alias("doc_id"), F.col("match").alias("item_id"), "score")


@query(f"WITH d AS ({DOCUMENTS}), g AS ({duck_digests('documents', 'doc_id', 'text', long=True)}) SELECT d.id AS doc_id, concat(3 * (1 << d.log_block_size), ':', d.bh1, ':', d.bh2) AS digest, CASE WHEN length(g.bh2) > 32 THEN 'OutputOverflow' END AS whole_error, CASE WHEN d.id % 3 = 0 THEN 'FixedSizeMismatch' END AS size_error, 'FixedSizeTooLarge' AS large_error, CASE WHEN d.id % 3 = 0 THEN false END AS too_large FROM d JOIN g ON g.id = d.id")
def generator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests with sizes set beforehand (wrong for every third document) and without truncation."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = F.octet_length("text").cast("long") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    rows = docs.select("doc_id", digests.digest_checked("text")["hash"].alias("h"), digests.digest_checked("text", truncate=False)["error"].alias("whole_error"), digests.digest_checked("text", told)["error"].alias("size_error"), digests.digest_checked("text", F.lit(1 << 40))["error"].alias("large_error"))
    return rows.select("doc_id", hashes.to_string("h").alias("digest"), "whole_error", "size_error", "large_error", digests.is_size_too_large_error("size_error").alias("too_large"))


@query(
    f"""WITH d AS ({DOCUMENTS}), l AS ({NORMALIZED}), s AS (SELECT d.id, {SHOWN} AS digest, concat(3 * (1 << n), ':', x, ':', y) AS normal, cast(len(list_distinct(list_concat({duck_keys('n', 'x')}, {duck_keys('n + 1', 'y')}))) AS int) AS n_keys, x, y FROM d JOIN l ON d.id = l.id)
SELECT id AS doc_id, digest, normal, n_keys, 100 AS own_score, 100 AS compared, length(digest) AS last_index, cast(n_keys AS bigint) AS n_rows FROM s"""
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that are registered for SQL."""
    from blockprint.api import register

    register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut(spark.sql("SELECT doc_id, ctph_digest(text) AS h FROM {docs}", docs=docs))
    text = "concat_ws(':', shiftleft(3L, h.log_block_size), h.bh1, h.bh2)"
    rows = spark.sql(f"SELECT doc_id, h, {text} AS digest FROM {{rows}}", rows=rows)
    out = spark.sql(
        "SELECT doc_id, digest, ctph_normalize(digest) AS normal, size(ctph_windows(digest)) AS n_keys, ctph_score(h.log_block_size, h.bh1, h.bh2, h.log_block_size, h.bh1, h.bh2) AS own_score,"
        " ctph_compare(digest, digest).score AS compared, ctph_parse(digest).last_index AS last_index FROM {rows}",
        rows=rows,
    )
    keys = spark.sql("SELECT doc_id, count(key) AS n_rows FROM {rows}, LATERAL ctph_index(digest) GROUP BY doc_id", rows=rows)
    return out.join(keys, "doc_id", "left").select(*out.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items() if s is not None}
