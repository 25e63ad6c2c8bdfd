"""The test tables seen as catalogue items, requests, frames and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, vocab
from ..operators.ordering import dense_index

DAY = 86400


# Declared schemas: reading a table starts no schema inference job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    zoned = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


def vector_count(spark, sf_dir) -> Column:
    """Number of stored vectors, as a scalar subquery."""
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("vec_label")
    )


def items(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    tempo = 90 + size % 61
    return p.select(
        key.alias("item_id"),
        pick(vocab.LABELS, F.floor(key / 3) + size).alias("label"),
        tempo.alias("tempo"),
        pick(vocab.DIFFICULTIES, size).alias("difficulty"),
        pick(vocab.ENERGIES, key).alias("energy"),
        F.when(F.col("p_type").isin("STANDARD", "LARGE"), "both")
        .when(F.col("p_type").isin("ECONOMY", "SMALL"), "lead_focus")
        .otherwise("follow_focus").alias("role"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("notes"),
        (tempo - 5).cast("double").alias("tempo_lo"),
        (tempo + 5).cast("double").alias("tempo_hi"),
        (5.0 + key % 16).alias("duration"),
        F.col("p_retailprice").alias("price"),
    )


def item_keys(spark, sf_dir) -> DataFrame:
    """Items with the id of their vector."""
    return items(spark, sf_dir).withColumn("vec_id", F.col("item_id") % vector_count(spark, sf_dir))


def item_vectors(spark, sf_dir) -> DataFrame:
    """Items with their vector."""
    return item_keys(spark, sf_dir).join(vectors(spark, sf_dir), "vec_id")


def requests(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        key.alias("req_id"),
        (90 + key % 61).cast("double").alias("tempo"),
        pick(vocab.DIFFICULTIES, nation).alias("difficulty"),
        pick(vocab.ENERGIES, F.floor(key / 7)).alias("energy"),
        pick(["both", "lead_focus", "follow_focus"], key).alias("role"),
        pick(list(vocab.STYLE_PRESETS), nation).alias("style"),
        F.col("c_acctbal").alias("balance"),
    )


def request_keys(spark, sf_dir) -> DataFrame:
    """Requests with the id of their vector."""
    return requests(spark, sf_dir).withColumn("vec_id", (F.col("req_id") * 7 + 3) % vector_count(spark, sf_dir))


def request_vectors(spark, sf_dir) -> DataFrame:
    return request_keys(spark, sf_dir).join(vectors(spark, sf_dir), "vec_id")


def scoring_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Both sides of the multi-factor score, with numeric levels, and their sizes."""
    left = request_vectors(spark, sf_dir).select(
        "req_id", "vec", "tempo",
        scores.level_rank(F.col("energy")).alias("energy_rank"),
        scores.level_rank(F.col("difficulty")).alias("difficulty_rank"),
    )
    right = item_vectors(spark, sf_dir).select(
        "item_id", "vec", F.col("tempo").cast("double").alias("tempo"), "tempo_lo", "tempo_hi",
        scores.level_rank(F.col("energy")).alias("energy_rank"),
        scores.level_rank(F.col("difficulty")).alias("difficulty_rank"),
    )
    sizes = (table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count())
    return left, right, sizes


def with_vectors(spark, sf_dir):
    """Adds the vector of a row by its vec_id."""
    return lambda df: df.join(vectors(spark, sf_dir).select("vec_id", "vec"), "vec_id")


def motion(items_df: DataFrame) -> DataFrame:
    """Start and end pose, speeds, coverage and direction of an item, from its vector."""
    return poses(items_df).select(
        "*",
        (F.col("item_id") % 4).alias("direction"),
        scores.level_rank(F.col("energy")).alias("energy_rank"),
        scores.level_rank(F.col("difficulty")).alias("difficulty_rank"),
    )


def poses(df: DataFrame) -> DataFrame:
    """Start and end pose, speeds and coverage read off a vector."""
    v = lambda i: F.get("vec", i)
    return df.select(
        "*",
        *[(90 + 90 * v(1 + j)).alias(f"start_{j}") for j in range(4)],
        *[(90 + 90 * v(5 + j)).alias(f"end_{j}") for j in range(4)],
        (F.abs(v(9)) / 10).alias("speed_start"),
        (F.abs(v(10)) / 10).alias("speed_end"),
        F.abs(v(11)).alias("coverage"),
        v(12).alias("cx"), v(13).alias("cy"),
    )


def events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("t", F.unix_micros("ts") / 1e6)


def day_of(t: Column) -> Column:
    return F.floor(t / DAY)


def frames(spark, sf_dir) -> DataFrame:
    """Ordered observations of a user; all of them are one song."""
    e = events(spark, sf_dir)
    # The unit only serves users above the row limit of dense_index, so it may be fine.
    idx = dense_index(e, ["user_id"], ["ts", "event_id"], F.date_trunc("minute", "ts"))
    return idx.select(
        "user_id",
        F.col("idx").alias("f"),
        "event_id", "ts", "t", "event_type", "value",
        (F.col("value") / 487.0).alias("x"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("y"),
    )


def pose_keys(spark, sf_dir) -> DataFrame:
    """Frames with the id of their pose."""
    return frames(spark, sf_dir).select(
        "user_id", "f", F.col("x").alias("confidence"), (F.col("event_id") % vector_count(spark, sf_dir)).alias("pose_id"))


def poses_of_vectors(spark, sf_dir) -> DataFrame:
    """33 landmarks read off each vector."""
    vec = F.col("vec")
    landmarks = F.transform(
        F.sequence(F.lit(0), F.lit(32)),
        lambda j: F.struct(
            F.get(vec, (j * 2) % 64).alias("x"),
            F.get(vec, (j * 2 + 1) % 64).alias("y"),
            F.get(vec, (j * 2 + 7) % 64).alias("z"),
            F.abs(F.get(vec, j)).alias("vis"),
        ),
    )
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("pose_id"), landmarks.alias("landmarks"))


def pose_frames(spark, sf_dir) -> DataFrame:
    """Frames with 33 landmarks read off the vector of the event."""
    return pose_keys(spark, sf_dir).join(poses_of_vectors(spark, sf_dir), "pose_id").select("user_id", "f", "confidence", "landmarks")


def slots(spark, sf_dir) -> DataFrame:
    """Lines of an order as the ordered slots of one sequence, with item attributes."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    unit = F.struct("l_shipdate", "l_linenumber", F.floor(F.col("l_partkey") / 10_000))
    idx = dense_index(li, ["l_orderkey"], order, unit)
    lines = idx.select(
        F.col("l_orderkey").alias("seq_id"),
        F.col("idx").alias("pos"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity") / 2.0).alias("seconds"),
        (1.0 - F.col("l_discount") * 5).alias("similarity"),
    )
    return lines.join(items(spark, sf_dir), "item_id")


# --- the same bindings for the SQL checks -------------------------------------

def _list(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _rank(col: str) -> str:
    return f"(case when {col} in ('low','beginner') then 1.0 when {col} in ('high','advanced') then 3.0 else 2.0 end)::double"


CTES = {
    "vecs": "select vec_id, embedding::double[] as vec, label as vec_label from embeddings",
    "nvec": "select count(*) as n from embeddings",
    "items": f"""
        select p_partkey as item_id,
          {_list(vocab.LABELS)}[((p_partkey // 3) + p_size) % 12 + 1] as label,
          90 + p_size % 61 as tempo,
          {_list(vocab.DIFFICULTIES)}[p_size % 3 + 1] as difficulty,
          {_list(vocab.ENERGIES)}[p_partkey % 3 + 1] as energy,
          case when p_type in ('STANDARD','LARGE') then 'both'
               when p_type in ('ECONOMY','SMALL') then 'lead_focus' else 'follow_focus' end as role,
          p_name || ' ' || p_brand as notes,
          (85 + p_size % 61)::double as tempo_lo, (95 + p_size % 61)::double as tempo_hi,
          (5 + p_partkey % 16)::double as duration, p_retailprice as price,
          p_partkey % (select n from nvec) as vec_id from part""",
    "item_vectors": "select * from items join vecs using (vec_id)",
    "requests": f"""
        select c_custkey as req_id, (90 + c_custkey % 61)::double as tempo,
          {_list(vocab.DIFFICULTIES)}[c_nationkey % 3 + 1] as difficulty,
          {_list(vocab.ENERGIES)}[(c_custkey // 7) % 3 + 1] as energy,
          ['both','lead_focus','follow_focus'][c_custkey % 3 + 1] as role,
          {_list(vocab.STYLE_PRESETS)}[c_nationkey % 4 + 1] as style,
          c_acctbal as balance, (c_custkey * 7 + 3) % (select n from nvec) as vec_id from customer""",
    "request_vectors": "select * from requests join vecs using (vec_id)",
    "motion": "select *, "
    + ", ".join(f"90 + 90 * vec[{2 + j}] as start_{j}" for j in range(4)) + ", "
    + ", ".join(f"90 + 90 * vec[{6 + j}] as end_{j}" for j in range(4))
    + f""", abs(vec[10]) / 10 as speed_start, abs(vec[11]) / 10 as speed_end, abs(vec[12]) as coverage,
        vec[13] as cx, vec[14] as cy, item_id % 4 as direction,
        {_rank('energy')} as energy_rank, {_rank('difficulty')} as difficulty_rank from item_vectors""",
    "ev": "select *, epoch_us(ts) / 1e6 as t from events",
    "frames": """
        select user_id, idx as f, event_id, ts, t, event_type, value,
          value / 487.0 as x, (props->>'$.k')::double / 100.0 as y
        from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as idx from ev)""",
    "pose_frames": """
        select user_id, f, x as confidence, [{'x': vec[(j*2)%64+1], 'y': vec[(j*2+1)%64+1],
          'z': vec[(j*2+7)%64+1], 'vis': abs(vec[j+1])} for j in range(0, 33)] as lm
        from (select *, event_id % (select n from nvec) as vec_id from frames) join vecs using (vec_id)""",
    "slots": """
        select * from (select l_orderkey as seq_id, idx as pos,
          l_partkey as item_id, l_quantity / 2.0 as seconds, 1.0 - l_discount * 5 as similarity
        from (select *, row_number() over (partition by l_orderkey
          order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as idx from lineitem))
        join items using (item_id)""",
}

_NEEDS = {
    "items": ["nvec"], "item_vectors": ["items", "vecs"], "requests": ["nvec"],
    "request_vectors": ["requests", "vecs"], "motion": ["item_vectors"], "frames": ["ev"],
    "pose_frames": ["frames", "nvec", "vecs"], "slots": ["items"],
}


def with_(*names: str, **extra: str) -> str:
    """WITH clause of the named bindings, in dependency order, plus extra parts."""
    done: list[str] = []

    def add(n):
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({CTES[n]})" for n in done] + [f"{n} as ({q})" for n, q in extra.items()]
    return "with " + ",\n".join(parts) + "\n"


sql_rank = _rank
