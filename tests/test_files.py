import pytest

from tallyspark.sources import files


def test_uploads_are_checked(tmp_path):
    good = tmp_path / "a.csv"
    good.write_bytes("﻿payer,amount\nAda,5\n".encode())
    files.check_upload(str(good))
    for name, data in (("a.txt", b"x"), ("b.csv", b"\xff\xfe\x00"), ("c.csv", b"  "), ("d.csv", b"x" * 1_000_001)):
        bad = tmp_path / name
        bad.write_bytes(data)
        with pytest.raises(ValueError):
            files.check_upload(str(bad))


def test_csv_and_jsonl(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('﻿reference,payer,extra\nR1,"Ada, B\nC",7\nR2\n', encoding="utf-8")
    rows = files.read_csv(spark, str(path), "statement").orderBy("reference").collect()
    assert (rows[0].reference, rows[0].payer, rows[0].extra, rows[0].amount, rows[1].payer) == ("R1", "Ada, B\nC", "7", None, None)
    quiz = tmp_path / "q.csv"
    quiz.write_text("What?,1,2,3,4,B\n")
    r = files.read_headerless(spark, str(quiz)).first()
    assert (r.question, r.choices, r.answer) == ("What?", ["1", "2", "3", "4"], "B")
    out = str(tmp_path / "out")
    files.write_jsonl(spark.createDataFrame([(2, "é"), (1, None)], "b int, a string"), out, "b")
    back = files.read_jsonl(spark, out, "a string, b int").orderBy("b").collect()
    assert [(r.a, r.b) for r in back] == [(None, 1), ("é", 2)]
    with pytest.raises(Exception):
        files.write_jsonl(spark.createDataFrame([(1,)], "b int"), out)
    files.append_only(spark.range(2), str(tmp_path / "log"))
    files.append_only(spark.range(2), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_case_files_records_and_manifests(spark, tmp_path):
    import json
    from datetime import datetime, timedelta, timezone

    import pytest

    from tallyspark.operators import calibration, ingest
    from tallyspark.sources import records

    (tmp_path / "a.yaml").write_text("id: one\nlines: [1, 2]\n")
    (tmp_path / "b.yaml").write_text("just text")
    (tmp_path / "c.yaml").write_text("a: [")
    got = {r.path[-6:]: (r.problem, r.case and r.case.id) for r in records.read_cases(spark, str(tmp_path / "*.yaml"), "id string, lines array<int>").collect()}
    assert got == {"a.yaml": (None, "one"), "b.yaml": ("no mapping", None), "c.yaml": ("no YAML", None)}
    full = dict.fromkeys(calibration.FEATURES, 0.5)
    rows = spark.createDataFrame([(full, 1, True), (None, 1, True), ({"x": 1.0}, 1, True), (full, 1, None), (full, 2, True)], "features map<string,double>, features_version int, label boolean")
    good, refused = records.calibration_records(rows)
    assert good.count() == 1 and sorted(r.reason for r in refused.collect()) == ["missing feature", "no features", "no label", "other version"]
    (tmp_path / "c.toml").write_text('model = "m"\n')
    assert records.load_config(str(tmp_path / "c.toml"), {"model": "m"}) == {"model": "m"}
    with pytest.raises(ValueError):
        records.load_config(str(tmp_path / "c.toml"), {"model": "n"})
    assert records.canonical_hash({"b": 1, "a": 2, "review": 3}, ("review",)) == records.canonical_hash({"a": 2, "b": 1})
    hashes = records.file_hashes(spark, str(tmp_path / "a.yaml")).first()
    assert hashes.bytes == 22 and len(hashes.sha256) == 64
    now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone(timedelta(hours=1)))
    assert records.run_folder(str(tmp_path), "x", now).name == "20260102T020405Z-x"
    with pytest.raises(FileExistsError):
        records.run_folder(str(tmp_path), "x", now)
    (tmp_path / "d.json").write_text(json.dumps({"id": "d"}))
    with pytest.raises(ValueError):
        records.promote(str(tmp_path / "d.json"), str(tmp_path / "t.json"), "me", "no")
    assert records.promote(str(tmp_path / "d.json"), str(tmp_path / "t.json"), "me", records.canonical_hash({"id": "d"}))["review"]["reviewer"] == "me" and not (tmp_path / "d.json").exists()
    lines = spark.createDataFrame([(2, "app", "train", "m", 3.0), (1, "app", "train", "m", None), (3, "chat", "val", "n", 5.0)], "line_no int, format string, split string, model string, tokens_per_second double")
    assert [r.line_no for r in records.first_of_format(lines, "app", 1).collect()] == [1]
    assert {(r.split, *r.missing) for r in records.missing_formats(lines).collect()} == {("train", "chat"), ("val", "app")}
    assert {(r.model, r.tokens_per_second, r.runs) for r in records.mean_speed(lines).collect()} == {("m", 3.0, 1), ("n", 5.0, 1)}
    demo = records.demo_rows(spark)
    assert [r.outcome for r in ingest.statement_outcomes(demo["statement"]).orderBy("row_no").collect()] == ["accepted", "accepted"]
    assert ingest.setup_register(demo["relationships"], ("student_id", "guardian_id"), ("student_id", "guardian_id")).where("outcome = 'accepted'").count() == 2
