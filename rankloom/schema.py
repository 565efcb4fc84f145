"""Table schemas and the run-time column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

JUDGMENTS = _struct(
    example_id=_S, query=_S, product_id=_S, product_locale=_S, esci_label=_S
)
CATALOG = _struct(
    product_id=_S,
    product_locale=_S,
    product_title=_S,
    product_description=_S,
    product_bullet_point=_S,
    product_brand=_S,
    product_color=_S,
)
RANKING = _struct(method=_S, query_id=_S, doc_id=_S, score=_D, rank=_I)
REQUESTS = _struct(
    request_id=_L,
    query=_S,
    method=_S,
    top_k=_I,
    alpha=_D,
    beta=_D,
    candidate_depth=_I,
)
LOG_RECORD = _struct(
    time=T.TimestampType(),
    request_id=_S,
    method=_S,
    path=_S,
    latency_ms=_D,
    status_code=_I,
)
TREE_NODES = _struct(
    tree=_I, node=_I, feature=_S, threshold=_D, left=_I, right=_I, value=_D, gain=_D
)

VERSIONS = _struct(number=_I, path=_S)
SCORE_COMMITS = _struct(folder=_S, replaces=T.ArrayType(T.StringType()))
TRAINING_HISTORY = _struct(trees=_I, ndcg=_D)
TRAINING_RUN = _struct(version=_S, params=_S, rows=_L, trees=_I)

# Columns the evaluation jobs need.
SAMPLE_REQUIRED = ("query", "product_id", "product_text", "relevance_score")


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, columns, name: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{name} lacks {missing}; it has {df.columns}")
    return df
