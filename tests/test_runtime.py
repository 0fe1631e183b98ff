import pytest

from lattica import Matrix, Vector, dtypes, runtime


def test_recorder_and_settings(spark):
    a = Matrix.from_coo([0, 1], [1, 0], [1, 2])
    with runtime.Recorder(start=False) as r:
        a.mxm(a)
    a.mxm(a)
    assert len(r) == 1 and "mxm plus_times" in r.data[0]
    assert runtime.about()["library"] == "lattica" and runtime.config["spark.sql.session.timeZone"] == "UTC"
    runtime.init()
    with pytest.raises(RuntimeError):
        runtime.init(blocking=True)


def test_user_types_field_by_field(spark):
    t = dtypes.register("pair_ab", {"a": "INT64", "b": "FP64"})
    v = Vector.from_coo([0, 1], [{"a": 1, "b": 2.0}, {"a": 3, "b": 4.0}], dtype=t)
    assert (v + v).new().to_dict() == {0: {"a": 2, "b": 4.0}, 1: {"a": 6, "b": 8.0}}
    assert v.apply("ainv").new().to_dict()[1] == {"a": -3, "b": -4.0}
    w = Vector.from_coo([0, 1], [[1, 2], [3, 4]], dtype="INT64[2]")
    assert w.ewise_mult(w, "times").new().to_dict() == {0: [1, 4], 1: [9, 16]}
