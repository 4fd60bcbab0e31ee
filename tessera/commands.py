"""The file commands as Spark jobs: ``spark-submit -m``-style, ``python -m tessera.commands NAME PATH [OUT]``.

inspect, verify, frames: a table of the containers below a path, shown or, with ``--out``, written as Parquet. reindex, repair: new containers of those
below a path; files that cannot be mended are in the table. encode: Y4M files to containers. decode: containers to Y4M files and, as Parquet, 16-bit sound.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import media, video, wire
from tessera.operators.ordered import running
from tessera.sources import container, y4m
from tessera.sources.resync import RANGE, Resync


def stem(name: str = "file_id"):
    return F.regexp_replace(name, r"\.bin$", "")


def inspect(spark: SparkSession, path: str, **options) -> DataFrame:
    """Epochs of every file with its stream count and whether their range lies inside it; a file without a sound index is a row with its error."""
    files = container.load(spark, path, "files", **options).select("file_id", F.col("bytes").alias("file_bytes"), F.col("stream_count").cast("long").alias("streams"), F.col("error_code").alias("broken"))
    j = files.join(container.load(spark, path, "epochs", **options), "file_id", "left")
    inside = F.col("byte_offset") + F.col("byte_len") <= F.col("file_bytes")
    return j.select("file_id", "streams", "epoch_id", "pts", "byte_offset", "byte_len", "duration", F.coalesce("broken", F.when(~inside, "BadFront")).alias("error_code"))


def verify(spark: SparkSession, path: str, **options) -> DataFrame:
    return media.verify(container.load(spark, path, **options), container.load(spark, path, "streams", **options))


def frames(spark: SparkSession, path: str, **options) -> DataFrame:
    return media.frame_list(container.load(spark, path, **options))


def mend(spark: SparkSession, path: str, out: str, work: str, repair: bool, span: int = RANGE) -> DataFrame:
    """Containers with a new index below ``out``, and a row for each file: epochs, dropped packets, or why it has none."""
    r = Resync(spark, path, work, span=span)
    r.save(out, repair)
    return r.outcome(repair).drop("file")


def encode(spark: SparkSession, path: str, out: str, q: int = 96, preset: str = "balanced", every: int = 48) -> DataFrame:
    """Containers of the Y4M files below a path; the rejected ones are the rows."""
    clips = y4m.load(spark, path)
    good = clips.where("error_code IS NULL").withColumn("clip_id", F.regexp_replace("clip_id", r"\.y4m$", ""))
    kinds = good.select("fps_n", "fps_d", "meta0").distinct().collect()  # one for each frame rate and colour description
    for k in kinds:
        tick = k.fps_d * 1_000_000 // k.fps_n
        own = media.epochs_by_cut(good.where((F.col("fps_n") == k.fps_n) & (F.col("fps_d") == k.fps_d) & (F.col("meta0") == k.meta0)), every)
        stream = wire.Stream(1, 1, 1, wire.TIMESCALE, 0, 0, k.fps_n << 16 | k.fps_d, k.meta0)
        container.save(media.mux_epochs(media.encode_video(own, 1, tick, q, preset), [stream]), out)
    return clips.where("error_code IS NOT NULL").select("clip_id", "error_code")


def decode(spark: SparkSession, path: str, out: str, since: int = 0) -> DataFrame:
    """Y4M files of the containers' one video stream and, below ``out``/sound, its sound; what was rejected is the rows."""
    pictures, sound = container.play(spark, path, since)
    rate = container.load(spark, path, "streams").where("kind = 'video'").select("file_id", "stream_id", F.shiftright("flags", 16).cast("int").alias("fps_n"), F.col("flags").bitwiseAND(0xFFFF).cast("int").alias("fps_d"), "meta0")
    good = pictures.where("error_code IS NULL").join(rate, ["file_id", "stream_id"])
    placed = running(good, "file_id", [F.col("pts").cast("long"), F.col("epoch_id"), F.col("frame_id")], {"place": F.lit(1)})
    y4m.save(placed.select(stem().alias("clip_id"), (F.col("place") - 1).alias("frame_index"), "width", "height", "fps_n", "fps_d", "meta0", "y", "u", "v", "error_code"), out)
    media.pcm_bytes(sound.where("error_code IS NULL").select("file_id", "stream_id", F.col("pts").cast("string").alias("pts"), "samples")).write.mode("overwrite").parquet(f"{out.rstrip('/')}/_sound")
    bad = pictures.select("file_id", "stream_id", "error_code").unionByName(sound.select("file_id", "stream_id", "error_code"))
    return bad.where("error_code IS NOT NULL")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="name", required=True)
    for name in ("inspect", "verify", "frames", "reindex", "repair", "encode", "decode"):
        c = sub.add_parser(name)
        c.add_argument("path")
        if name in ("reindex", "repair", "encode", "decode"):
            c.add_argument("to")
        c.add_argument("--out", help="Parquet folder for the table; shown otherwise")
        if name in ("reindex", "repair"):
            c.add_argument("--work", required=True, help="a folder that all executors share")
        if name == "encode":
            c.add_argument("--q", type=int, default=96)
            c.add_argument("--preset", choices=sorted(video.PRESETS), default="balanced")
            c.add_argument("--every", type=int, default=48)
        if name == "decode":
            c.add_argument("--since", type=int, default=0, help="microseconds")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The table of a command; its files are written by then."""
    a = parser().parse_args(argv)
    jobs = {
        "inspect": lambda: inspect(spark, a.path), "verify": lambda: verify(spark, a.path), "frames": lambda: frames(spark, a.path),
        "reindex": lambda: mend(spark, a.path, a.to, a.work, False), "repair": lambda: mend(spark, a.path, a.to, a.work, True),
        "encode": lambda: encode(spark, a.path, a.to, a.q, a.preset, a.every), "decode": lambda: decode(spark, a.path, a.to, a.since),
    }
    found = jobs[a.name]()
    if a.out:
        found.write.mode("overwrite").parquet(a.out)
    return found


def main(argv: list[str] | None = None) -> None:
    import sys

    argv = sys.argv[1:] if argv is None else argv
    found = run(SparkSession.builder.appName("tessera").getOrCreate(), argv)
    if "--out" not in argv:
        found.show(1000, truncate=False)


if __name__ == "__main__":
    main()
