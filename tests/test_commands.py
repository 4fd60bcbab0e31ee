"""The file commands on a folder of containers and Y4M files."""

import pytest

from tessera import commands
from tessera.operators import wire
from tessera.plans import media as plans
from tessera.sources import container, y4m
from tests.conftest import SF
from tests.test_codecs import small_file


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("commands")
    clips = plans.clips(spark, SF, 5).where("clip_id IN ('pan', 'ui')")
    y4m.save(spark.createDataFrame(clips.collect(), clips.schema), f"{d}/y4m")
    (d / "y4m" / "bad.y4m").write_bytes(b"nothing")
    return d


def test_encode_decode(spark, folder):
    bad = commands.run(spark, ["encode", f"{folder}/y4m", f"{folder}/bin", "--q", "1", "--preset", "fast", "--every", "2"]).collect()
    assert [tuple(r) for r in bad] == [("bad", "BadHeader")]
    assert {r.file_id: r.n for r in commands.run(spark, ["verify", f"{folder}/bin"]).where("kind = 'video'").collect()} == {"pan.bin": 5, "ui.bin": 5}
    assert commands.run(spark, ["frames", f"{folder}/bin"]).count() == 10
    assert commands.run(spark, ["decode", f"{folder}/bin", f"{folder}/back"]).count() == 0
    for name in ("pan", "ui"):  # lossless
        assert (folder / "back" / f"{name}.y4m").read_bytes() == (folder / "y4m" / f"{name}.y4m").read_bytes()
    assert spark.read.parquet(f"{folder}/back/_sound").count() == 0


def test_inspect_and_mend(spark, folder, tmp_path):
    good = small_file()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.bin").write_bytes(good)
    (tmp_path / "in" / "hurt.bin").write_bytes(good[:-40] + b"\xff" + good[-39:])
    (tmp_path / "in" / "bad.bin").write_bytes(b"x" * 60)
    rows = commands.run(spark, ["inspect", f"{tmp_path}/in", "--out", f"{tmp_path}/table"]).collect()
    assert len(rows) == 7 and [r.error_code for r in rows if r.file_id == "bad.bin"] == ["BadMagic"] and {r.error_code for r in rows if r.file_id == "good.bin"} == {None}
    assert spark.read.parquet(f"{tmp_path}/table").count() == 7
    strict = {r.file_id: r.error_code for r in commands.run(spark, ["reindex", f"{tmp_path}/in", f"{tmp_path}/strict", "--work", f"{tmp_path}/w1"]).collect()}
    assert strict == {"good.bin": None, "hurt.bin": "PayloadChecksum", "bad.bin": "BadMagic"}
    fixed = {r.file_id: (r.dropped, r.error_code) for r in commands.run(spark, ["repair", f"{tmp_path}/in", f"{tmp_path}/fixed", "--work", f"{tmp_path}/w2"]).collect()}
    assert fixed["good.bin"] == (0, None) and fixed["hurt.bin"][0] >= 1 and fixed["bad.bin"][1] == "BadMagic"
    assert (tmp_path / "fixed" / "good.bin").read_bytes() == wire.regroup(good, True)[0] and not (tmp_path / "strict" / "hurt.bin").exists()
    assert container.load(spark, f"{tmp_path}/fixed").where("error_code IS NOT NULL").count() == 0
