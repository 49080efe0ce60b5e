"""Headers, images, frame and plasma files, parameter files, and streams, on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoflow.plans import job
from sinoflow.sources import headers, interfile
from sinoflow.streaming import listmode


def test_image_round_trip(spark, tmp_path):
    data = np.random.default_rng(2).random((3, 4, 5)).astype("<f4")
    (tmp_path / "a.v").write_bytes(data.tobytes())
    (tmp_path / "a.hv").write_text(interfile.header_text((3, 4, 5), (2.0, 1.5, 1.0), "a.v"))
    assert interfile.image_meta((tmp_path / "a.hv").read_text())["spacing"] == [2.0, 1.5, 1.0]
    image = interfile.read_image(spark, f"{tmp_path}/a.hv")
    assert {(r.z, r.y, r.x): r.value for r in image.collect()} == {i: float(v) for i, v in np.ndenumerate(data)}
    interfile.write_image(image.filter("z <> 1"), f"{tmp_path}/b.hv", (3, 4, 5))
    data[1] = 0
    assert (tmp_path / "b.v").read_bytes() == data.tobytes()
    (tmp_path / "a.v").write_bytes(b"1234")
    with pytest.raises(Exception, match="the header says"):
        interfile.read_image(spark, f"{tmp_path}/a.hv").collect()


def test_small_files(spark, tmp_path):
    assert headers.time_frames("2 10\n0 5\n1 30\n\n") == [(0, 10), (10, 20), (25, 55)]
    assert headers.time_frames("") == []
    h = headers.header("!Matrix_size [2] := 7\n; no := 1\nname of  data file := a b.v\n")
    assert h == {"matrix size": {2: "7"}, "name of data file": "a b.v"}
    assert headers.values("{1, 2,3}") == [1, 2, 3]
    (tmp_path / "p.if").write_text("2\n0.5 1 2\n1.5\t3 4\n")
    assert list(map(tuple, headers.plasma_samples(spark, f"{tmp_path}/p.if").collect())) == [(0.5, 1, 2), (1.5, 3, 4)]


def test_parameter_files():
    text = "OSSPSParameters :=\nobjective Parameters :=\nprior type := quadratic\nend objective Parameters :=\nnumber of subsets := 3\nEND :=\n"
    assert job.parse(text) == {"ossps": {"objective": {"prior type": "quadratic"}, "number of subsets": "3"}}
    with pytest.raises(ValueError, match="no method"):
        job.run("unknownParameters :=\nEND :=\n", None, None, None)


def test_streamed_rates(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 4 != 0).alias("is_prompt"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = listmode.count_rates(listmode.event_stream(spark, f"{tmp_path}/in"), "100 seconds", "0 seconds").orderBy("start").collect()
    assert [(r.prompts, r.delayeds) for r in got[:2]] == [(7, 3), (8, 2)]
    assert len(got) == 9  # the last window is still open
    rows.limit(0).write.parquet(f"{tmp_path}/none")
    assert listmode.count_rates(listmode.event_stream(spark, f"{tmp_path}/none"), "100 seconds", "0 seconds").count() == 0
