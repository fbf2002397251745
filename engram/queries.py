"""Named queries over the driver's test tables; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.functions import vector as vec
from engram.functions.metadata import metadata_contains
from engram.functions.redact import redact_df
from engram.functions.tiers import Bucket
from engram.operators import billing, cells, forget, keys, paging, quality, ratelimit, recall, tenancy, usage, writes
from engram.schemas import USAGE_EVENTS
from engram.session import new_dir
from engram.sources import testdata as td
from engram.sources.pages import PageDirectory
from engram.sources.sinks import append_memories, json_rows
from engram.sources.vector_store import VectorStore
from engram.sources.versions import VersionedMemories
from engram.sources.tables import billing_fields, read_table, stream_table
from engram.streaming import pending as pending_stream
from engram.streaming import ratelimit as rate_stream
from engram.streaming import sinks as stream_sinks

DIM = td.VECTOR_DIM
TEXT_DIM = 16
AS_OF = "2025-01-01 00:00:00"
SALT = "test salt"
# two calls per day, so that the test events are both allowed and refused
TEST_BUCKETS = {"free": Bucket(2, 2, 86_400_000)}


def _num(col: str, digits: int = 6) -> Column:
    return F.round(F.col(col), digits).alias(col)


def _big(col: str) -> Column:
    return F.col(col).cast("bigint").alias(col)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("request_id", _big("rank"), "id", _num("similarity"))


# --- retrieval -------------------------------------------------------------


def recall_batch(spark: SparkSession, sf: str) -> DataFrame:
    found = recall.recall(td.vector_memories(spark, sf), td.vector_requests(spark, sf), DIM)
    return found.select(
        "request_id", _big("rank"), "id", "content", _num("similarity"), "namespace",
        tx.iso_millis(F.col("created_at")).alias("created_at"),
    )


def recall_batch_blocks(spark: SparkSession, sf: str) -> DataFrame:
    requests = td.vector_requests(spark, sf)
    return _ranked(recall.recall(td.vector_memories(spark, sf), requests, DIM, strategy="blocks"))


def recall_namespace_all(spark: SparkSession, sf: str) -> DataFrame:
    requests = td.vector_requests(spark, sf, threshold=0.2).drop("namespace")
    return _ranked(recall.search(td.vector_memories(spark, sf), requests, DIM))


def nearest_k(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(recall.nearest(td.vector_memories(spark, sf), td.vector_requests(spark, sf, k=3), DIM))


def _filtered_requests(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("cast(substr(namespace, 3) as int)")
    by_bucket = F.concat(F.lit('{"bucket":"b'), (F.col("request_id") % 3).cast("string"), F.lit('"}'))
    by_label = F.concat(F.lit('{"even":true,"label":'), label.cast("string"), F.lit(".0}"))
    as_text = F.concat(F.lit('{"label":"'), label.cast("string"), F.lit('"}'))
    kind = F.col("request_id") % 4
    wanted = F.when(kind == 0, by_bucket).when(kind == 1, by_label).when(kind == 2, as_text).otherwise(F.lit("{}"))
    return td.vector_requests(spark, sf).withColumn("metadata_filter", wanted)


def recall_metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(recall.recall(td.vector_memories(spark, sf), _filtered_requests(spark, sf), DIM))


def metadata_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = td.vector_memories(spark, sf)
    label_1 = metadata_contains(F.col("metadata"), F.lit('{"label":1.0,"even":false}'))
    label_text = metadata_contains(F.col("metadata"), F.lit('{"label":"1"}'))
    # filters that are no object match nothing; of a repeated key the last value counts
    twice = F.concat(F.lit('{"label":-1,'), F.substring("metadata", 2, 1_000_000))
    more = {
        "broken": metadata_contains(F.col("metadata"), F.lit('{"label":')),
        "listed": metadata_contains(F.col("metadata"), F.lit("[1]")),
        "first_of_repeated": metadata_contains(twice, F.lit('{"label":-1}')),
        "last_of_repeated": metadata_contains(twice, F.lit('{"label":1}')),
        "no_filter": metadata_contains(F.col("metadata"), F.lit("{}")),
    }
    more = [c.alias(n) for n, c in more.items()]
    return rows.select("id", label_1.alias("label_1_odd"), label_text.alias("label_text"), *more)


def recall_formatted(spark: SparkSession, sf: str) -> DataFrame:
    memories, requests = td.vector_memories(spark, sf), td.vector_requests(spark, sf, k=3, threshold=0.1)
    found = recall.recall(memories, requests, DIM)
    checked = quality.require_valid_results(found, ["id", "content", "similarity", "namespace", "created_at"])
    return recall.format_recall(checked, requests)


def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    found = recall.recall_approximate(td.vector_memories(spark, sf), td.vector_requests(spark, sf), DIM)
    return _ranked(found)


def ann_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Search over an index of inverted cells against the exact one: every embedding asks for 5 of its user's."""
    path = new_dir(spark, "cells")
    memories = td.vector_memories(spark, sf)
    requests = td.vector_requests(spark, sf).drop("namespace")
    cells.build_cells(memories, path, DIM)
    found = cells.recall_cells(spark, path, requests).select("request_id", "id", F.lit(1).alias("hit"))
    exact = recall.search(memories, requests, DIM).select("request_id", "user_id", "id")
    share = exact.join(found, ["request_id", "id"], "left").groupBy("user_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("hits"))
    pairs = F.col("requests") * F.col("rows")
    return cells.work(spark, path, requests).join(share, "user_id").select(
        "user_id", F.col("requests").alias("n_requests"), pairs.alias("n_pairs"), "n_true",
        (F.col("hits") * 10 >= F.col("n_true") * 9).alias("found_9_of_10"), (F.col("scored") * 10 <= pairs * 3).alias("scored_under_30_percent"),
    )


def list_page(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("request_id")
    requests = td.vector_requests(spark, sf, k=3).select(
        "request_id", "user_id", "namespace", "k", (number % 11).cast("int").alias("offset"),
        F.when(number % 2 == 0, "created_at").otherwise("updated_at").alias("order"),
    )
    pages = paging.list_pages(td.vector_memories(spark, sf), requests)
    return pages.select("request_id", _big("rank"), "id", "content", "namespace")


def list_keyset(spark: SparkSession, sf: str) -> DataFrame:
    memories = td.vector_memories(spark, sf)
    number = F.col("id").cast("bigint")
    with_cursor = number % 3 != 0
    requests = memories.select(
        number.alias("request_id"), "user_id", F.when(number % 2 == 1, F.col("namespace")).alias("namespace"),
        F.lit(4).alias("k"), F.when(with_cursor, F.col("created_at")).alias("cursor_created_at"),
        F.when(with_cursor, F.col("id")).alias("cursor_id"),
    )
    pages = paging.keyset_pages(memories, requests)
    return pages.select("request_id", _big("rank"), "id", "has_more", "next_id")


def list_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Offset pages and cursor pages from a page directory of small blocks."""
    memories = td.vector_memories(spark, sf)
    pages = PageDirectory(spark, new_dir(spark, "pages"))
    pages.build(memories, block=8)
    number = F.col("id").cast("bigint")
    offsets = memories.select(
        number.alias("request_id"), "user_id", "namespace", F.lit(3).alias("k"), (number % 29).alias("offset"),
        F.when(number % 2 == 0, "created_at").otherwise("updated_at").alias("order"),
    )
    cursors = memories.select(
        number.alias("request_id"), "user_id", F.when(number % 2 == 1, F.col("namespace")).alias("namespace"), F.lit(10).alias("k"),
        F.when(number % 3 != 0, F.col("created_at")).alias("cursor_created_at"), F.when(number % 3 != 0, F.col("id")).alias("cursor_id"),
    )
    listed = pages.list_pages(offsets).select(F.lit("offset").alias("by"), "request_id", _big("rank"), "id", "content", F.lit(None).cast("string").alias("next_id"))
    walked = pages.keyset_pages(cursors).select(F.lit("cursor").alias("by"), "request_id", _big("rank"), "id", "content", "next_id")
    return listed.union(walked)


# --- text and vectors ------------------------------------------------------


def normalize_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = tx.with_normalized(td.text_requests(spark, sf), "content", "text")
    return rows.select(
        F.col("seq").alias("doc_id"),
        tx.utf16_length(F.col("text")).cast("bigint").alias("units"),
        tx.content_hash(F.col("text")).alias("content_hash"),
    )


def dedupe_documents(spark: SparkSession, sf: str) -> DataFrame:
    hashed = normalize_hash(spark, sf)
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def mock_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """All 1,536 numbers of every text's vector, as two values and two sums."""
    rows = tx.with_normalized(td.text_requests(spark, sf), "content", "content")
    dim = vec.EMBEDDING_DIM
    embedded = rows.select(F.col("seq").alias("doc_id"), vec.mock_embedding(F.col("content"), dim).alias("v"))
    checked = embedded.where(vec.has_dimension(F.col("v"), dim))
    place = F.sequence(F.lit(1), F.lit(dim))
    plain = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    weighted = F.aggregate(F.zip_with("v", place, lambda x, i: x.cast("double") * i), F.lit(0.0), lambda s, x: s + x)
    return checked.select(
        "doc_id", F.round(F.col("v")[0].cast("double"), 4).alias("v0"), F.round(F.col("v")[15].cast("double"), 4).alias("v15"),
        F.round(plain, 3).alias("total"), F.round(weighted / dim, 3).alias("weighted"),
    )


def _byte_vectors(texts: list[str]) -> list[list[float]]:
    """Four numbers per text; five, which is one too many, where its bytes number a multiple of 50."""
    sizes = [len(t.encode()) for t in texts]
    return [[float(n), float(n % 7), 1.0, float(len(t)), *([0.0] if n % 50 == 0 else [])] for t, n in zip(texts, sizes)]


def embed_once(spark: SparkSession, sf: str) -> DataFrame:
    """A store of vectors filled by the documents of every second number, then by all, then by all again."""
    store = VectorStore(spark, new_dir(spark, "vectors"), 4)
    docs, before, out = _docs(spark, sf), 0, None
    for run, wanted in enumerate(("doc_id % 2 = 0", "true", "true"), 1):
        rows, rejects = store.embed(docs.where(wanted), _byte_vectors, "text")
        held = store.rows().count()
        sums = rows.agg(
            F.count("embedding").alias("n_rows"), F.sum(F.col("embedding")[0]).cast("bigint").alias("bytes"), F.sum(F.col("embedding")[3]).cast("bigint").alias("units")
        )
        numbers = {"run": run, "n_embedded": held - before, "n_rejected": rejects.count()}
        line = sums.select("*", *[F.lit(v).cast("int" if c == "run" else "bigint").alias(c) for c, v in numbers.items()])
        out, before = line if out is None else out.union(line), held
    return out


def vector_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = td.vector_memories(spark, sf).select("id", vec.vector_to_text(F.col("embedding")).alias("text"), "embedding")
    back = vec.vector_from_text(F.col("text"))
    distance = vec.cosine_distance(back, F.col("embedding"))
    return rows.select("id", F.size(back).cast("bigint").alias("dim"), F.abs(F.round(distance, 6)).alias("distance"))


def escape_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.sha2(tx.escape_markup(F.col("html")), 256).alias("escaped_hash"))


def redact_log(spark: SparkSession, sf: str) -> DataFrame:
    clean = redact_df(td.log_rows(spark, sf))
    return clean.select("conv_id", "turn", "content", F.col("meta.query").alias("query"), F.col("meta.role").alias("role"))


def redact_map(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows whose fields are map entries."""
    named = F.create_map(F.lit("content"), F.col("text"), F.lit("role"), F.col("role"), F.lit("embedding"), F.lit("0.5"))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.struct(named.alias("fields")).alias("entry"))
    fields = redact_df(rows)
    return fields.select(
        "conv_id", "turn", F.col("entry.fields")["content"].alias("content"), F.col("entry.fields")["role"].alias("role"),
        F.col("entry.fields")["embedding"].alias("embedding"),
    )


def metadata_size(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of metadata with repeated keys and numbers in long forms."""
    number = F.col("n_chars").cast("string")
    metadata = F.concat(F.lit('{"n": 7, "n" : '), number, F.lit('.0, "e":1e2, "t":[1.50, "1.0, "], "u":"\\u00e9"}'))
    return _docs(spark, sf).select("doc_id", tx.json_size_bytes(metadata).cast("bigint").alias("size"))


def json_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = td.vector_memories(spark, sf).select("id", "namespace", "created_at", F.array("updated_at").alias("times"))
    return json_rows(rows)


# --- writes ----------------------------------------------------------------


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents as memories that are already stored."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("seq")).distinct()
    rows = td.text_requests(spark, sf).join(labels, "seq", "left_semi")
    rows = tx.with_normalized(rows, "content", "content")
    moment = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("seq"))
    return rows.select(
        F.col("seq").cast("string").alias("id"), "user_id", "namespace", "content", "metadata",
        vec.mock_embedding(F.col("content"), TEXT_DIM).alias("embedding"),
        tx.content_hash(F.col("content")).alias("content_hash"),
        moment.alias("created_at"), moment.alias("updated_at"),
    )


def _remember(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    embed = writes.mock_embedder(TEXT_DIM)
    return writes.remember(_stored(spark, sf), td.text_requests(spark, sf), AS_OF, embed)


def remember_quota(spark: SparkSession, sf: str) -> DataFrame:
    return _remember(spark, sf)[1]


def remember_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _remember(spark, sf)[0].select("id", "user_id", "namespace", "content_hash", "metadata")


def append_and_read(spark: SparkSession, sf: str) -> DataFrame:
    """All documents appended as two batches, the second delivered twice; read back by the table's schema, per user."""
    out = new_dir(spark, "append")
    docs = tx.with_normalized(td.text_requests(spark, sf), "content", "content")
    rows = docs.withColumns({"embedding": vec.mock_embedding(F.col("content")), "content_hash": tx.content_hash(F.col("content"))})
    for batch, wanted in (("a", "seq % 2 = 0"), ("b", "seq % 2 = 1"), ("b", "seq % 2 = 1")):
        append_memories(rows.where(wanted), f"{out}/memories", batch, AS_OF)
    back = read_table(spark, "memories", f"{out}/memories")
    return back.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_distinct("content_hash").alias("n_texts"),
        F.count_if(vec.has_dimension(F.col("embedding"))).alias("n_wide"), F.count_if(F.col("created_at") == F.lit(AS_OF).cast("timestamp")).alias("n_dated"),
    )


def find_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    asked = td.text_requests(spark, sf)
    asked = tx.with_normalized(asked, "content", "content")
    wanted = asked.select("user_id", "namespace", tx.content_hash(F.col("content")).alias("content_hash"))
    return writes.find_by_hash(_stored(spark, sf), wanted)


def _update_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One update per stored memory: new text, a text shared by many, a text another
    memory holds, or none; some by the wrong user, some with metadata."""
    stored = _stored(spark, sf)
    held = stored.groupBy("user_id", "namespace").agg(
        F.min_by("content", F.col("id").cast("bigint")).alias("held")
    )
    number = F.col("id").cast("bigint")
    kind = number % 4
    content = (
        F.when(kind == 0, F.concat("content", F.lit(" v2")))
        .when(kind == 1, F.lit("shared  note"))
        .when(kind == 2, F.col("held"))
        .otherwise(F.lit(""))
    )
    rows = stored.join(held, ["user_id", "namespace"])
    return rows.select(
        number.alias("seq"), "id",
        F.when(number % 11 == 0, F.lit("nobody")).otherwise(F.col("user_id")).alias("user_id"),
        content.alias("content"), F.when(number % 3 == 0, F.lit('{"v":2}')).alias("metadata"),
    )


def _update(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    embed = writes.mock_embedder(TEXT_DIM)
    return writes.update(_stored(spark, sf), _update_requests(spark, sf), AS_OF, embed)


def update_content(spark: SparkSession, sf: str) -> DataFrame:
    return _update(spark, sf)[1]


def update_metadata(spark: SparkSession, sf: str) -> DataFrame:
    table = _update(spark, sf)[0]
    return table.select("id", "content_hash", "metadata", tx.iso_millis(F.col("updated_at")).alias("updated_at"))


def versioned_writes(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as memories of 1,536 numbers; an update for three users, then a deletion for one: both versions by user."""
    docs = tx.with_normalized(td.text_requests(spark, sf), "content", "content")
    moment = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("seq"))
    memories = docs.select(
        F.col("seq").cast("string").alias("id"), "user_id", "namespace", "content", "metadata",
        vec.mock_embedding(F.col("content")).alias("embedding"), tx.content_hash(F.col("content")).alias("content_hash"),
        moment.alias("created_at"), moment.alias("updated_at"),
    )
    table = VersionedMemories(spark, new_dir(spark, "versions"))
    table.create(memories, part_rows=200)
    number = F.col("seq")
    asked = docs.where((number % 4 == 0) & F.col("user_id").isin("0", "1", "2"))
    changes = asked.select(
        "seq", number.cast("string").alias("id"), F.when(number % 11 == 0, F.lit("nobody")).otherwise(F.col("user_id")).alias("user_id"),
        F.concat("content", F.lit(" v2 "), number.cast("string")).alias("content"), F.when(number % 3 == 0, F.lit('{"v":2}')).alias("metadata"),
    )
    table.commit(changes, lambda rows: writes.update(rows, changes, AS_OF))
    gone = docs.where((number % 6 == 1) & (F.col("user_id") == "1")).select("seq", number.cast("string").alias("id"), "user_id")
    table.commit(gone, lambda rows: writes.forget(rows, gone))
    both = table.read(1).withColumn("version", F.lit(1)).union(table.read(2).withColumn("version", F.lit(2)))
    updated = F.col("updated_at") == F.lit(AS_OF).cast("timestamp")
    return both.groupBy("version", "user_id").agg(
        F.count("*").alias("n"), F.count_if(updated).alias("n_updated"), F.count_if(F.col("metadata") == '{"v":2}').alias("n_metadata"),
        F.sum(F.conv(F.substring("content_hash", 1, 8), 16, 10).cast("bigint")).alias("hash_sum"),
        F.count_if(vec.has_dimension(F.col("embedding"))).alias("n_wide"),
        F.sum(F.round(F.col("embedding")[0].cast("double") * 1000).cast("bigint")).alias("first_sum"),
    )


def update_fields(spark: SparkSession, sf: str) -> DataFrame:
    memories = td.vector_memories(spark, sf)
    number = F.col("id").cast("bigint")
    requests = memories.select(
        number.alias("seq"), "id",
        F.when(number % 5 == 0, F.lit("nobody")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(number % 2 == 0, F.lit("new text")).alias("content"),
        F.when(number % 3 == 0, F.lit("{}")).alias("metadata"),
        F.when(number % 7 == 0, F.lit("moved")).alias("namespace"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("string").alias("content_hash"),
    )
    outcomes = writes.update_fields(memories, requests, AS_OF)[1]
    return outcomes.select("seq", "id", F.array_join("updated_fields", ",").alias("updated_fields"), "error_code")


def update_fields_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The new table when most memories are updated twice in a batch."""
    memories = td.vector_memories(spark, sf)
    number = F.col("id").cast("bigint")
    given = lambda cond, value: F.when(cond, F.lit(value))
    base = [F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("content_hash")]
    first = memories.select(
        number.alias("seq"), "id", F.when(number % 5 == 0, F.lit("nobody")).otherwise(F.col("user_id")).alias("user_id"),
        given(number % 2 == 0, "new text").alias("content"), given(number % 3 == 0, "{}").alias("metadata"),
        given(number % 7 == 0, "moved").alias("namespace"), *base,
    )
    second = memories.select(
        (number + 10_000_000).alias("seq"), "id", "user_id", given(number % 4 == 0, "newer text").alias("content"),
        F.lit(None).cast("string").alias("metadata"), given(number % 6 == 0, "last").alias("namespace"), *base,
    )
    table = writes.update_fields(memories, second.unionByName(first), AS_OF)[0]
    return table.select("id", "content", "namespace", "metadata")


def _forget_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each memory is asked for twice; every third number by a wrong user."""
    number = F.col("id").cast("bigint")
    user = F.when(number % 3 == 0, ((number + 1) % 5).cast("string")).otherwise(F.col("user_id"))
    asked = td.vector_memories(spark, sf).select("id", user.alias("user_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    return asked.select((number * 2 + F.col("n")).alias("seq"), "id", "user_id")


def forget_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return writes.forget(td.vector_memories(spark, sf), _forget_requests(spark, sf))[1]


def forget_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return writes.forget(td.vector_memories(spark, sf), _forget_requests(spark, sf))[0].select("id", "user_id")


def _preview(spark: SparkSession, sf: str):
    number = F.col("request_id")
    space = F.when(number % 3 == 0, F.col("namespace")).when(number % 3 == 1, F.lit(""))
    requests = td.vector_requests(spark, sf, k=3, threshold=0.2).withColumn("namespace", space)
    return forget.preview(td.vector_memories(spark, sf), requests, AS_OF, SALT, DIM)


def forget_preview(spark: SparkSession, sf: str) -> DataFrame:
    return _preview(spark, sf)[0]


def forget_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _preview(spark, sf)[1].select("request_id", _big("rank"), "id", "content", _num("similarity"))


def _confirms(summaries: DataFrame) -> DataFrame:
    """Two tries per token, at 0 to 6 minutes after the preview; every fourth first try by a wrong user."""
    number = F.col("request_id")
    late = F.expr("make_interval(0,0,0,0,0,cast(request_id % 7 as int) + n, 0)")
    wrong = (number % 4 == 1) & (F.col("n") == 0)
    return summaries.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (number * 2 + F.col("n")).alias("seq"),
        F.when(wrong, F.lit("nobody")).otherwise(F.col("user_id")).alias("user_id"),
        F.col("confirmation_token").alias("token"),
        (F.lit(AS_OF).cast("timestamp") + late).alias("at"),
    )


def forget_confirm(spark: SparkSession, sf: str) -> DataFrame:
    summaries, _, pending = _preview(spark, sf)
    outcomes = forget.confirm(td.vector_memories(spark, sf), pending, _confirms(summaries))[1]
    return outcomes.select("seq", "status", "deleted_count", "error_code", "message")


def forget_confirm_survivors(spark: SparkSession, sf: str) -> DataFrame:
    summaries, _, pending = _preview(spark, sf)
    return forget.confirm(td.vector_memories(spark, sf), pending, _confirms(summaries))[0].select("id")


def delete_nearest(spark: SparkSession, sf: str) -> DataFrame:
    requests = td.vector_requests(spark, sf, k=2)
    found = writes.delete_nearest(td.vector_memories(spark, sf), requests, DIM)[1]
    return found.select("request_id", _big("rank"), "id")


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    people = td.users(spark, sf)
    wanted = people.select((F.col("id").cast("bigint") * 2).cast("string").alias("user_id"))
    memories = td.vector_memories(spark, sf)
    return writes.delete_users(people, memories, td.api_keys(spark, sf), td.usage_events(spark, sf), wanted)[1]


def tenant_split(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("id").cast("bigint")
    context = F.when(number % 4 == 0, F.lit(None)).when(number % 4 == 1, F.lit("0")).otherwise(F.col("user_id"))
    rows = td.vector_memories(spark, sf).select("id", "user_id", context.alias("ctx_user_id"))
    return tenancy.split_by_tenant(rows)[1]


def tenant_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Usage events of the users on the free tier."""
    contexts = td.users(spark, sf).where(F.col("tier") == "free").select(F.col("id").alias("user_id"))
    return tenancy.visible_rows(td.usage_events(spark, sf), contexts).select("id", "user_id", "tool_name")


# --- usage -----------------------------------------------------------------


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.usage_summary(td.usage_events(spark, sf))
    return out.withColumn("day", F.col("day").cast("string"))


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return usage.usage_summary(td.usage_events(spark, sf), ["tool_name", "api_key_id"], totals=True)


def usage_latency(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.latency_percentiles(td.usage_events(spark, sf))
    return out.select("tool_name", "calls", _num("p50_ms"), _num("p95_ms"), _big("max_ms"))


def usage_errors(spark: SparkSession, sf: str) -> DataFrame:
    return usage.usage_errors(td.usage_events(spark, sf))


def usage_timeline(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.usage_timeline(td.usage_events(spark, sf), "user_id", 10)
    return out.select("user_id", _big("rank"), "id", tx.iso_millis(F.col("occurred_at")).alias("occurred_at"))


def usage_by_key(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.usage_timeline(td.usage_events(spark, sf), "api_key_id", 3)
    return out.select("api_key_id", _big("rank"), "id")


def usage_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = usage.usage_windows(td.usage_events(spark, sf), "1 day")
    return out.withColumn("window_start", tx.iso_millis(F.col("window_start")))


def usage_build(spark: SparkSession, sf: str) -> DataFrame:
    calls = td.usage_events(spark, sf)
    decided = ratelimit.replay(td.rate_calls(spark, sf), TEST_BUCKETS)
    decisions = decided.select(F.col("seq").cast("string").alias("request_id"), "allowed")
    rows = usage.build_usage_events(calls, decisions)
    return rows.select("request_id", "user_id", "tool_name", _big("tokens_consumed"), _big("latency_ms"), "success", "error_code")


def _all_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a memory; only what counting needs."""
    return td.text_requests(spark, sf).select(F.col("seq").cast("string").alias("id"), "user_id", "namespace")


def memory_counts(spark: SparkSession, sf: str) -> DataFrame:
    return usage.memory_counts(_all_stored(spark, sf))


def quota_headroom(spark: SparkSession, sf: str) -> DataFrame:
    tiers = keys.key_tiers(td.api_keys(spark, sf), td.users(spark, sf))
    return usage.quota_headroom(_all_stored(spark, sf), tiers)


def rate_limit_replay(spark: SparkSession, sf: str) -> DataFrame:
    return ratelimit.replay(td.rate_calls(spark, sf), TEST_BUCKETS).select("key", "seq", "allowed", "remaining", "retry_after")


# --- billing and keys ------------------------------------------------------


def _billing_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Subscription events of ``orders``, and one re-binding of every customer to the customer id seven on."""
    number = F.col("c_custkey")
    payload = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    F.concat(F.lit("cus_"), (number + 7).cast("string")).alias("id"),
                    F.struct(number.cast("string").alias("app_user_id")).alias("metadata"),
                ).alias("object")
            ).alias("data")
        )
    )
    bindings = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("evt_c"), number.cast("string")).alias("id"),
        F.lit("customer.created").alias("event_type"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("1995-01-01 00:00:00")) + number * 3600).alias("received_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        payload.alias("payload"),
    )
    return td.billing_events(spark, sf).unionByName(bindings)


def _fold(spark: SparkSession, sf: str) -> billing.BillingResult:
    arrivals = _billing_arrivals(spark, sf)
    seen = arrivals.where(F.col("event_type") == "customer.subscription.updated")
    return billing.fold(td.users(spark, sf), seen, arrivals, td.price_map(spark), AS_OF)


def billing_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _fold(spark, sf).users.select("id", "tier", "stripe_customer_id")


def billing_effects(spark: SparkSession, sf: str) -> DataFrame:
    return _fold(spark, sf).effects.select("id", "user_id", "tier", "n_bound")


def billing_processed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fold(spark, sf).processed
    return rows.select("id", "event_type", tx.iso_millis(F.col("processed_at")).alias("processed_at"))


def price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    fields = billing_fields(F.col("payload"))
    events = td.billing_events(spark, sf).select("id", fields["price_id"].alias("price_id"), fields["customer_id"].alias("customer_id"))
    return billing.lookup_prices(events, td.price_map(spark)).select("id", "customer_id", "price_id", "new_tier")


def unprocessed_events(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("event_type") == "customer.subscription.deleted"
    inbox = td.billing_events(spark, sf).withColumn("processed_at", F.when(status, F.col("received_at")))
    return billing.unprocessed(inbox).select("id", "event_type")


def insert_once(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = td.billing_events(spark, sf)
    inbox = arrivals.where(F.col("event_type") == "customer.subscription.created")
    repeated = arrivals.unionByName(arrivals.withColumn("received_at", F.expr("received_at + interval 1 day")))
    fresh = writes.insert_once(inbox, repeated)
    return fresh.select("id", "event_type", tx.iso_millis(F.col("received_at")).alias("received_at"))


def subscription_messages(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    price = F.col("o_orderpriority")
    tier = F.when(price == "1-URGENT", "team").when(price == "2-HIGH", "pro").when(price == "5-LOW", "free").otherwise("gold")
    messages = orders.select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).cast("string").alias("user_id"), tier.alias("tier")
    )
    return billing.set_tiers(td.users(spark, sf), messages)[0].select("id", "tier")


def effective_tier(spark: SparkSession, sf: str) -> DataFrame:
    return keys.key_tiers(td.api_keys(spark, sf), td.users(spark, sf))


def active_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.list_keys(td.api_keys(spark, sf)).select("id", "user_id", "label", "tier")


def all_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = keys.list_keys(td.api_keys(spark, sf), include_revoked=True)
    return rows.select("id", "user_id", tx.iso_millis(F.col("revoked_at")).alias("revoked_at"))


def issue_keys(spark: SparkSession, sf: str) -> DataFrame:
    table = td.api_keys(spark, sf)
    number = F.col("id").cast("bigint")
    wanted = F.when(number % 5 == 0, "team").when(number % 5 == 1, "gold").when(number % 5 == 2, "starter")
    requests = table.select(
        number.alias("seq"), F.col("id").alias("auth_key_id"), F.col("tier").alias("auth_tier"), "user_id",
        F.concat(F.lit("new"), "id").alias("new_id"), F.lit("h").alias("key_hash"), F.lit("p").alias("key_prefix"),
        F.lit("").alias("label"), wanted.alias("tier"),
    )
    added, outcomes = keys.issue(table, requests, AS_OF)
    return outcomes.join(added.select("id", "tier"), "id", "left").select("seq", _big("code"), "id", "tier")


def revoke_keys(spark: SparkSession, sf: str) -> DataFrame:
    table = td.api_keys(spark, sf)
    number = F.col("id").cast("bigint")
    requests = table.select(
        number.alias("seq"), F.when(number % 3 == 0, F.lit("nobody")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(number % 4 == 0, F.col("id")).otherwise(F.lit("other")).alias("auth_key_id"), "id",
    )
    return keys.revoke(table, requests, AS_OF)[1].select("seq", "id", _big("code"))


def rotate_keys(spark: SparkSession, sf: str) -> DataFrame:
    table = td.api_keys(spark, sf)
    number = F.col("id").cast("bigint")
    requests = table.select(
        number.alias("seq"), F.when(number % 3 == 0, F.lit("nobody")).otherwise(F.col("user_id")).alias("user_id"), "id",
        F.concat(F.lit("new"), "id").alias("new_id"), F.lit("h").alias("key_hash"), F.lit("p").alias("key_prefix"),
    )
    rotated = keys.rotate(table, requests, AS_OF)[0]
    return rotated.select("id", "user_id", "label", "tier", tx.iso_millis(F.col("revoked_at")).alias("revoked_at"))


def touch_keys(spark: SparkSession, sf: str) -> DataFrame:
    seen = td.usage_events(spark, sf).select("api_key_id", F.col("occurred_at").alias("at"))
    touched = keys.touch_keys(td.api_keys(spark, sf), seen)
    return touched.select("id", tx.iso_millis(F.col("last_used_at")).alias("last_used_at"))


# --- quality ---------------------------------------------------------------


def _judged(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("doc_id", *columns, "error_code", "message", F.size("issues").cast("bigint").alias("n_issues"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def validate_remember(spark: SparkSession, sf: str) -> DataFrame:
    metadata = F.concat(F.lit('{"n": "'), F.repeat(F.lit("x"), F.col("n_chars").cast("int")), F.lit('"}'))
    blank = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.col("text"))
    rows = _docs(spark, sf).select("doc_id", blank.alias("content"), metadata.alias("metadata"))
    return _judged(quality.check_remember(rows))


# One good metadata filter, one nested, one with nine keys.
FILTERS = (
    '{"a":1,"b":"x","c":true}',
    '{"a":{"b":1}}',
    '{"a":1,"b":1,"c":1,"d":1,"e":1,"f":1,"g":1,"h":1,"i":1}',
)


def validate_recall(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id")
    wanted = F.when(number % 4 == 0, FILTERS[0]).when(number % 4 == 1, FILTERS[1]).when(number % 4 == 2, FILTERS[2])
    rows = _docs(spark, sf).select(
        "doc_id", F.col("text").alias("query"), (number % 60).cast("double").alias("limit"),
        ((number % 15) / 10).alias("threshold"), wanted.alias("metadata_filter"),
    )
    return _judged(quality.check_recall(rows))


def validate_list(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id")
    rows = _docs(spark, sf).select(
        "doc_id", ((number % 220) / 2).alias("limit"), (number % 5 - 1).cast("double").alias("offset"),
        F.when(number % 3 == 0, "created_at").when(number % 3 == 1, "content").alias("order"),
    )
    return _judged(quality.check_list(rows))


def _uuid_or_not(number: Column) -> Column:
    hexed = F.sha2(number.cast("string"), 256)
    pieces = [F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.concat(F.lit("4"), F.substring(hexed, 14, 3)),
              F.concat(F.lit("a"), F.substring(hexed, 18, 3)), F.substring(hexed, 21, 12)]
    return F.when(number % 3 == 0, F.lit("not-a-uuid")).otherwise(F.concat_ws("-", *pieces))


def validate_update(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id")
    rows = _docs(spark, sf).select(
        "doc_id", _uuid_or_not(number).alias("id"), F.when(number % 2 == 0, F.col("text")).alias("content"),
        F.when(number % 5 == 0, F.lit('{"a":1}')).when(number % 5 == 1, F.lit("[1]")).alias("metadata"),
    )
    return _judged(quality.check_update(rows), "warning")


def validate_forget(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id")
    rows = _docs(spark, sf).select(
        "doc_id", F.when(number % 7 == 0, "by_id").when(number % 7 == 1, "all").otherwise("by_query").alias("mode"),
        _uuid_or_not(number).alias("id"), F.when(number % 2 == 0, F.col("text")).alias("query"),
        F.when(number % 3 == 0, F.lit("token")).alias("confirmation_token"), (number % 60).cast("double").alias("limit"),
    )
    return _judged(quality.check_forget(rows), "kind")


def fk_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every third user and every fourth key are missing."""
    people = td.users(spark, sf).where(F.col("id").cast("bigint") % 3 != 0)
    known = td.api_keys(spark, sf).where(F.col("id").cast("bigint") % 4 != 0)
    return quality.fk_audit(people, known, td.vector_memories(spark, sf), td.usage_events(spark, sf))


def constraint_audit(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = td.billing_events(spark, sf)
    again = arrivals.where(F.col("event_type") == "customer.subscription.deleted")
    return quality.constraint_audit(
        td.users(spark, sf), td.api_keys(spark, sf), td.usage_events(spark, sf), arrivals.unionByName(again)
    )


def tenant_leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    memories, requests = td.vector_memories(spark, sf), td.vector_requests(spark, sf)
    # the results of every fourth request are handed to another tenant
    other = F.when(F.col("request_id") % 4 == 0, F.lit("intruder")).otherwise(F.col("user_id"))
    leaked = quality.leaked_rows(recall.recall(memories, requests, DIM), requests.withColumn("user_id", other), memories)
    return leaked.groupBy().agg(F.count("*").alias("n_leaked"))


def result_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = recall.search(td.vector_memories(spark, sf), td.vector_requests(spark, sf, threshold=-1.0), DIM)
    broken = quality.check_results(found.withColumn("similarity", F.round("similarity", 9)), ["id", "content"])
    return broken.select("request_id", "id", "message")


# --- streams ---------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


class _Streamed:
    """Reads one test table as a stream, so that the batch mappings apply to it."""

    def __init__(self, spark: SparkSession):
        self.read = self
        self._spark = spark

    def parquet(self, path: str) -> DataFrame:
        sf, _, name = path.rpartition("/")
        return _stream(self._spark, sf, name.removesuffix(".parquet"))


def usage_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = new_dir(spark, "usage-windows")
    events = td.usage_events(_Streamed(spark), sf)
    query = stream_sinks.write_usage_windows(
        events, f"{out}/data", f"{out}/checkpoint", "1 day", final_only=False, once=True
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/data")
    return rows.withColumn("window_start", tx.iso_millis(F.col("window_start")))


def usage_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """A range of days from stored sketches, each estimate judged by its true rank or number."""
    out, events = new_dir(spark, "usage-states"), td.usage_events(spark, sf)
    usage.write_states(events, out)
    days = events.select(F.to_date("occurred_at").alias("day"))
    since, until = days.select(F.date_add(F.min("day"), 3).cast("string"), F.date_sub(F.max("day"), 3).cast("string")).first()
    found = usage.usage_between(spark.read.parquet(out), since, until)
    inside = events.where((F.col("occurred_at") >= since) & (F.col("occurred_at") < until)).select("tool_name", "latency_ms", "user_id")
    near = []
    for point in (50, 95):
        low, high = F.count_if(F.col("latency_ms") < F.col(f"p{point}_ms")), F.count_if(F.col("latency_ms") <= F.col(f"p{point}_ms"))
        near.append(((low * 100 <= (point + 1) * F.count("*")) & (high * 100 >= (point - 1) * F.count("*"))).alias(f"p{point}_within_1_percent"))
    people = F.count_distinct("user_id")
    near.append((F.abs(F.first("users") - people) * 20 <= people).alias("users_within_5_percent"))
    judged = inside.join(found.select("tool_name", "p50_ms", "p95_ms", "users"), "tool_name").groupBy("tool_name").agg(*near)
    return found.join(judged, "tool_name").select("tool_name", "calls", "tokens", "failures", _big("max_ms"), *[c for c in judged.columns if "within" in c])


def usage_windows_final(spark: SparkSession, sf: str) -> DataFrame:
    """The windows that the watermark has passed, appended once each; the others stay in state."""
    out = new_dir(spark, "usage-windows")
    events = td.usage_events(_Streamed(spark), sf)
    stream_sinks.write_usage_windows(events, f"{out}/data", f"{out}/checkpoint", "1 day", once=True).awaitTermination()
    rows = spark.read.schema("user_id string, window_start timestamp, calls long, tokens long").parquet(f"{out}/data")
    return rows.select("user_id", tx.iso_millis(F.col("window_start")).alias("window_start"), "calls", "tokens")


def usage_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Usage written while the table's path is blocked, kept aside, then replayed; a second replay finds nothing."""
    out = new_dir(spark, "usage-letters")
    # a file stands where the table's folder should be
    spark.range(1).coalesce(1).write.parquet(f"{out}/blocked")
    block = spark.read.parquet(f"{out}/blocked").inputFiles()[0]
    events = td.usage_events(_Streamed(spark), sf)
    stream_sinks.write_usage(events, f"{block}/usage", f"{out}/checkpoint", once=True, dead_letters=f"{out}/dead").awaitTermination()
    first = stream_sinks.replay_usage(spark, f"{out}/dead", f"{out}/usage")
    second = stream_sinks.replay_usage(spark, f"{out}/dead", f"{out}/usage")
    rows = spark.read.schema(USAGE_EVENTS).parquet(*[f"{out}/usage/batch={b}" for b in first])
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")).withColumn("replayed_again", F.lit(len(second)).cast("bigint"))


def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = new_dir(spark, "rate-limit")
    decided = rate_stream.rate_limit_stream(td.rate_calls(_Streamed(spark), sf), TEST_BUCKETS)
    stream_sinks.write_table(decided, f"{out}/data", f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("key", "seq", "allowed", "remaining", "retry_after")


def confirm_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = new_dir(spark, "confirms")
    summaries, _, pending = _preview(spark, sf)
    previews = pending.withColumn("at", F.lit(AS_OF).cast("timestamp"))
    events = pending_stream.token_events(previews, _confirms(summaries))
    events.write.parquet(f"{out}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{out}/events")
    decided = pending_stream.confirm_stream(stream, live=False)
    stream_sinks.write_table(decided, f"{out}/data", f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("seq", "status", "message")


def confirm_timers(spark: SparkSession, sf: str) -> DataFrame:
    """The same tries on the clock of the events, with the ids to delete; at the end no token is left in the state."""
    out = new_dir(spark, "confirms")
    summaries, _, pending = _preview(spark, sf)
    previews = pending.withColumn("at", F.lit(AS_OF).cast("timestamp"))
    events = pending_stream.token_events(previews, _confirms(summaries))
    events.write.parquet(f"{out}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{out}/events")
    query = stream_sinks.write_table(pending_stream.confirm_by_event_time(stream), f"{out}/data", f"{out}/checkpoint", once=True)
    query.awaitTermination()
    held = max((op["numRowsTotal"] for op in query.lastProgress["stateOperators"]), default=0) if query.lastProgress else 0
    rows = spark.read.parquet(f"{out}/data")
    return rows.select("seq", "status", F.array_join(F.array_sort("memory_ids"), ",").alias("memory_ids"), F.lit(held).cast("bigint").alias("held_at_end"))


def billing_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The history in six deliveries in order of time, each a micro-batch of one stream."""
    out = new_dir(spark, "billing")
    arrivals = _billing_arrivals(spark, sf).withColumn("second", F.unix_timestamp("received_at"))
    ends = [float("-inf"), *arrivals.approxQuantile("second", [i / 6 for i in range(1, 6)], 0.01), float("inf")]
    tables = stream_sinks.BillingTables(spark, f"{out}/tables")
    tables.begin(td.users(spark, sf))
    last = -1
    for low, high in zip(ends, ends[1:]):
        arrivals.where((F.col("second") > low) & (F.col("second") <= high)).drop("second").write.mode("append").json(f"{out}/inbox")
        stream = stream_table(spark, "stripe_events", f"{out}/inbox", "json")
        query = stream_sinks.apply_billing(stream, tables, td.price_map(spark), AS_OF, f"{out}/checkpoint", once=True)
        query.awaitTermination()
        last = query.lastProgress["batchId"] if query.lastProgress else last
    return tables.users(last).select("id", "tier", "stripe_customer_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        recall_batch, recall_batch_blocks, recall_namespace_all, nearest_k, recall_metadata_filter, metadata_matches,
        recall_formatted, ann_recall, ann_quality, list_page, list_keyset, list_deep, normalize_hash, dedupe_documents, mock_embedding,
        embed_once, vector_text, escape_text, redact_log, redact_map, metadata_size, json_results, remember_quota, remember_rows, append_and_read, find_by_hash,
        update_content, update_metadata, versioned_writes, update_fields, update_fields_rows, forget_by_id, forget_survivors, forget_preview,
        forget_matches, forget_confirm, forget_confirm_survivors, delete_nearest, cascade_delete, tenant_split,
        tenant_rows,
        usage_summary, usage_rollup, usage_latency, usage_errors, usage_timeline, usage_by_key, usage_windows,
        usage_build, memory_counts, quota_headroom, rate_limit_replay, billing_fold, billing_effects,
        billing_processed, price_lookup, unprocessed_events, insert_once, subscription_messages, effective_tier,
        active_keys, all_keys, issue_keys, revoke_keys, rotate_keys, touch_keys, validate_remember,
        validate_recall, validate_list, validate_update, validate_forget, fk_audit, constraint_audit,
        tenant_leak_audit, result_audit, usage_windows_stream, usage_windows_final, usage_dead_letters, usage_sketches, rate_limit_stream, confirm_stream, confirm_timers, billing_stream,
    )
}
