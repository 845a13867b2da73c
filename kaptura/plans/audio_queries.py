"""Queries over sound made from the driver's tables: each vector as a WAV file in the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from kaptura.plans.queries import query
from kaptura.session import scratch, table
from kaptura.sources import wave

RATE, SECONDS, STRIDE = 20, 1_000, 7

_LEVEL = f"abs(round(embedding[(%s) * {STRIDE} %% len(embedding) + 1]::double * 32767))"
_WINDOWS = f"list_transform(range(0, i1 - i0 - 4), lambda w: {_LEVEL % '(i0 + w)'} + {_LEVEL % '(i0 + w + 1)'} + {_LEVEL % '(i0 + w + 2)'} + {_LEVEL % '(i0 + w + 3)'})"


@query(
    f"""with recursive cuts as (select vec_id, 0 n, 0.0::double cur from embeddings
  union all select vec_id, n + 1, a + (list_position(x, list_min(x)) - 1 + 2) / {RATE}.0::double from
    (select vec_id, n, a, {_WINDOWS} x from (select c.vec_id, n, embedding, a, floor(a * {RATE})::bigint i0, floor(b * {RATE})::bigint i1
      from (select *, greatest(cur + 60, cur + 300 - 3) a, least({SECONDS} - 1, cur + 300 + 3)::double b from cuts where cur + 300 < {SECONDS}) c join embeddings e on e.vec_id = c.vec_id))),
bounds as (select vec_id, n chunk, round(cur, 2) a, coalesce(lead(round(cur, 2)) over (partition by vec_id order by n), {SECONDS})::double b from cuts)
select vec_id, chunk, a chunk_start, b chunk_end, floor(b * {RATE})::bigint - floor(a * {RATE})::bigint n_samples, round(list_sum(list_transform(range(floor(a * {RATE})::bigint, floor(b * {RATE})::bigint), lambda i: {_LEVEL % 'i'})))::bigint loudness
from bounds join embeddings using (vec_id)"""
)
def wave_chunks(spark, sf_dir):
    """Every vector as a sound of 1,000 seconds, written, cut at quiet places and read chunk by chunk."""
    folder = scratch(spark, "waves")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    level = lambda i: F.round(F.get("embedding", (i * STRIDE) % F.size("embedding")).cast("double") * 32767).cast("short")
    sounds = vectors.select(F.concat(F.lit(f"{folder}/"), "vec_id", F.lit(".wav")).alias("path"), F.transform(F.sequence(F.lit(0), F.lit(RATE * SECONDS - 1)), level).alias("samples"))
    wave.write_waves(sounds, RATE).agg(F.sum("n_frames")).collect()
    files = vectors.select("vec_id", F.concat(F.lit(f"{folder}/"), "vec_id", F.lit(".wav")).alias("path"))
    heard = wave.heard(wave.planned(files))
    loud = F.aggregate(F.transform("samples", lambda x: F.abs(x).cast("double") * 32768), F.lit(0.0), lambda a, x: a + x)
    return heard.select("vec_id", "chunk", "chunk_start", "chunk_end", F.size("samples").cast("long").alias("n_samples"), F.round(loud).cast("long").alias("loudness"))
