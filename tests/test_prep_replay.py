"""A recipe fitted with k-NN imputation fills the missing cells of new rows."""

from sparkwright.plans import prep as PR


def test_knn_step_is_replayed(spark):
    rows = [(i, float(i) if i % 7 else None, "a" if i % 2 else "b") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id long, x double, y string").selectExpr("id", "x", "id * 2.0D AS z", "y")
    p = PR.prep_quick(df, "y", ["id"], missing="knn", scaling="none")
    fitted = {r["id"]: r["x"] for r in p.frame.collect()}
    assert None not in fitted.values()
    assert {r["id"]: r["x"] for r in p.apply(df).collect()} == fitted
    # a new row takes the mean of its five nearest fitted rows with a value: z = 20 is x = 10
    new = spark.createDataFrame([(100, None, 20.0, "a"), (101, 3.0, 6.0, "b")], "id long, x double, z double, y string")
    assert {r["id"]: r["x"] for r in p.apply(new).collect()} == {100: 10.0, 101: 3.0}


def _rows(df, key="id"):
    return {r[key]: tuple(r) for r in df.collect()}


def test_statistics_come_from_train_rows_only(spark):
    """Changing test rows changes no fitted number, category, code or donor."""
    rows = [(i, float(i) if i % 7 else None, i * 3.0, f"c{i % 9}", "p" if i % 2 else "q") for i in range(120)]
    schema = "id long, x double, z double, c string, t string"
    df = spark.createDataFrame(rows, schema)
    specs = {"x": PR.ColumnSpec(missing="median", outliers="clip", scaling="robust"), "z": PR.ColumnSpec(binning="equal_frequency", scaling="power"),
             "c": PR.ColumnSpec(encoding="frequency", rare_categories="group_as_other", rare_threshold=3.0)}
    flows = [lambda d: PR.prep_quick(d, "t", ["id"], missing="knn"), lambda d: PR.prep_minimal(d, "t", ["id"]),
             lambda d: PR.prep_quick(d, "t", ["id"], missing="median", scaling="robust"),
             lambda d: PR.prep_custom(d, "t", ["id"], specs, normalize=True)]
    for flow in flows:
        first = flow(df)
        test = {r["id"] for r in first.frame.where("split = 'test'").collect()}
        other = [r if r[0] not in test else (r[0], 1e6, -1e6, "never seen", r[4]) for r in rows]
        second = flow(spark.createDataFrame(other, schema))
        a, b = _rows(first.frame), _rows(second.frame)
        assert test and set(a) == set(b) and all(a[i] == b[i] for i in a if i not in test)


def test_values_that_were_not_fitted(spark):
    rows = [(i, f"c{i % 12}", "p" if i % 2 else "q") for i in range(240)]
    p = PR.prep_minimal(spark.createDataFrame(rows, "id long, c string, t string"), "t", ["id"])
    new = spark.createDataFrame([(1, "c3", "p"), (2, "other", "q"), (3, None, "p")], "id long, c string, t string")
    got = {r["id"]: r["c"] for r in p.apply(new).collect()}
    assert got[2] == got[3] == PR.UNSEEN and got[1] >= 0


def test_a_stage_is_one_job_however_many_columns(spark):
    """Fitting takes the same jobs for few and many columns; a coded text column adds its dictionary's join alone."""
    counts = []
    for width in (2, 12):
        cols = [f"id * {k + 1}.5 + IF(id % {k + 7} = 0, NULL, 0) AS n{k}" for k in range(width)]
        cols += [f"IF(id % {k + 9} = 0, NULL, concat('v', id % {k + 2})) AS s{k}" for k in range(width)]
        df = spark.range(300).selectExpr("id", *cols, "IF(id % 2 = 0, 'p', 'q') AS t")
        spark.sparkContext.setJobGroup(f"width-{width}", "")
        PR.prep_quick(df, "t", ["id"], missing="median", encoding="label")
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"width-{width}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] > 0 and counts[1] <= counts[0] + 2 * 10 + 2


def test_streamed_batches_are_replaced_not_repeated(spark, tmp_path):
    from sparkwright.streaming import apply as SA
    rows = [(i, float(i) if i % 5 else None, i * 2.0, "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y string")
    p = PR.prep_quick(df, "y", ["id"], missing="knn")
    assert p.runs_jobs
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = SA.read_stream(spark, str(tmp_path / "in"), df.schema, max_files_per_trigger=1)
    out = SA.replay_to_files(stream, p, out_dir=str(tmp_path / "out"))
    want = _rows(p.apply(df))
    assert _rows(spark.read.parquet(out).drop("batch").select(*p.apply(df).columns)) == want
    SA.replay_to_files(stream, p, out_dir=str(tmp_path / "out"))      # a restart without its checkpoint delivers all again
    assert spark.read.parquet(out).count() == 60
