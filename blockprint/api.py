"""Registration of the functions for use in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from blockprint.functions import digests, plain
from blockprint.functions.hashes import HASH

ERROR = "struct<kind:string,origin:string,offset:int>"
COMPARED = f"struct<score:int,side:string,error:{ERROR}>"
PARSED = f"struct<hash:{HASH},last_index:int,error:{ERROR}>"
ARROW_HASH = pa.struct([("log_block_size", pa.int32()), ("bh1", pa.string()), ("bh2", pa.string())])
ARROW_ERROR = pa.struct([("kind", pa.string()), ("origin", pa.string()), ("offset", pa.int32())])
ARROW_PARSED = pa.struct([("hash", ARROW_HASH), ("last_index", pa.int32()), ("error", ARROW_ERROR)])
ARROW_COMPARED = pa.struct([("score", pa.int32()), ("side", pa.string()), ("error", ARROW_ERROR)])


def register(spark: SparkSession) -> None:
    """ctph_digest, ctph_digest_long, ctph_parse, ctph_normalize, ctph_score, ctph_compare, ctph_windows
    and the table function ctph_index(hash)."""

    def texts(name: str, kind: str, arrow: pa.DataType, one):
        @F.arrow_udf(kind)
        def f(v: pa.Array) -> pa.Array:
            return pa.array([None if x is None else one(x) for x in v.to_pylist()], arrow)

        spark.udf.register(name, f)

    def on_bytes(name: str, truncate: bool):
        @F.arrow_udf(HASH)
        def f(v: pa.Array) -> pa.Array:
            return digests.digest_array(v.cast(pa.binary()) if pa.types.is_string(v.type) else v, truncate)

        spark.udf.register(name, f)

    on_bytes("ctph_digest", True)
    on_bytes("ctph_digest_long", False)
    texts("ctph_parse", PARSED, ARROW_PARSED, lambda t: plain.parse(t, long=True, normalized=False))
    texts("ctph_normalize", "string", pa.string(), plain.normalize)
    texts("ctph_windows", "array<bigint>", pa.list_(pa.int64()), plain.index_keys)

    @F.arrow_udf(COMPARED)
    def ctph_compare(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [None if None in (x, y) else plain.compare(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.array(out, ARROW_COMPARED)

    spark.udf.register("ctph_compare", ctph_compare)
    spark.udf.register("ctph_score", digests._scores())

    @F.udtf(returnType="key: bigint")
    class Index:
        def eval(self, hash: str):
            for k in plain.index_keys(hash) or [] if hash is not None else []:
                yield Row(key=k)

    spark.udtf.register("ctph_index", Index)
