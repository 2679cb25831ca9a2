"""Files on disk: discovery, encodings, bad lines, incremental load, streaming, exports."""

import os

import pytest
from pyspark.sql import functions as F

from vigilia import schema as S
from vigilia.plans import ingest
from vigilia.sources import files, sinks, versions
from vigilia.streaming import ingest as live

HEAD = "NUM_INTRP_UCI|NUM_POSTO_UCI|NUM_UC_UCI|DESC_INTRP|KVA_INTRP"


def put(folder, name, lines, encoding="utf-8", head=HEAD):
    with open(os.path.join(folder, name), "wb") as out:
        out.write(("\n".join([head, *lines]) + "\n").encode(encoding))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    put(d, "Interrupcoes_IQS_20240115120000_CSL.CSV", ["1|P|10|ação|1,5", "2|P|10| |", "1|P|10|de novo|9"])
    put(d, "Interrupcoes_IQS_20240116120000_nrt.csv", ["3|P|11|ação – “x”|2"], "cp1252")
    put(d, "Interrupcoes_IQS_20240201120000_OES.CSV", ["4|Q|12|ação\x81|3"], "latin-1")
    put(d, "Interrupcoes_IQS_20231201120000_OES.CSV", ["9|Q|12|velho|3"])
    put(d, "outra_coisa.CSV", ["5|Q|12|x|3"])
    return str(d)


def paths(spark, folder, **kw):
    return [r.arquivo_path for r in files.discover(spark, folder, **kw).collect()]


def test_discover(spark, folder):
    rows = files.discover(spark, folder, min_anomes="202401").orderBy("carimbo").collect()
    assert [(r.anomes, r.regional) for r in rows] == [("202401", "CSL"), ("202401", "NRT"), ("202402", "OES")]
    assert all(r.arquivo_tamanho_bytes > 0 for r in rows)


def test_encodings(spark, folder):
    got = {os.path.basename(r.arquivo_path)[17:25]: (r.encoding, r.cabecalho) for r in files.classify(files.scan_lines(spark, paths(spark, folder))).collect()}
    assert {k: v[0] for k, v in got.items()} == {"20240115": "utf-8", "20240116": "cp1252", "20240201": "latin-1", "20231201": "utf-8"}
    assert {v[1] for v in got.values()} == {HEAD}
    text = {r.NUM_INTRP_UCI: r.DESC_INTRP for r in files.read_outage_files(spark, paths(spark, folder)).collect() if r.DESC_INTRP}
    assert text["3"] == "ação – “x”" and text["4"] == "ação\x81" and text["1"] in ("ação", "de novo")


def test_blanks_headers_and_tags(spark, folder, tmp_path):
    put(folder, "Interrupcoes_IQS_20240117120000_LES.CSV", ["77|8|R"], head="NUM_UC_UCI|NUM_INTRP_UCI|NUM_POSTO_UCI")
    rows = {r.NUM_INTRP_UCI: r for r in files.read_outage_files(spark, paths(spark, folder, min_anomes="202401")).collect()}
    assert rows["2"].DESC_INTRP is None and rows["2"].KVA_INTRP is None
    assert (rows["8"].NUM_UC_UCI, rows["8"].NUM_POSTO_UCI, rows["8"].REGIONAL_ORIGEM, rows["8"].DESC_INTRP) == ("77", "R", "LES", None)


def test_ingest_is_incremental(spark, folder, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    put(folder, "Interrupcoes_IQS_20240118120000_LES.CSV", ["50|P|1|ok|1", "51|P|1|sobra|1|2|3"])
    first = ingest.ingest(spark, folder, table, log, "r1", min_anomes="202401").collect()
    assert {r.arquivo_nome[17:25]: r.status for r in first} == {"20240115": "processado", "20240116": "processado", "20240118": "erro", "20240201": "processado"}
    assert sorted(r.NUM_INTRP_UCI for r in spark.read.parquet(table).collect()) == ["1", "2", "3", "4", "50"]
    assert [r.linha for r in spark.read.parquet(table + "_rejeitadas").collect()] == ["51|P|1|sobra|1|2|3"]
    kept = {r.NUM_INTRP_UCI: r.DESC_INTRP for r in spark.read.parquet(table).collect()}["1"]
    put(folder, "Interrupcoes_IQS_20240120120000_CSL.CSV", ["1|P|10|terceira|7", "6|P|10|nova|7"])
    second = ingest.ingest(spark, folder, table, log, "r2", min_anomes="202401").collect()
    # The failed file is tried again, the new one loads, known keys keep their first row.
    assert {r.arquivo_nome[17:25] for r in second} == {"20240118", "20240120"}
    rows = {r.NUM_INTRP_UCI: r.DESC_INTRP for r in spark.read.parquet(table).collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "50", "6"] and rows["1"] == kept
    assert spark.read.parquet(table).count() == 6


def test_pending_and_log_upkeep(spark, folder):
    found = files.discover(spark, folder)
    log = found.select(*files.FILE_KEY, "arquivo_nome", "anomes").withColumns({
        "status": F.when(F.col("anomes") == "202401", F.lit("Processado ")).otherwise(F.lit("erro")), "processado_em": F.lit("1"), "linhas_lidas": F.lit(1)})
    assert {r.anomes for r in files.pending(found, log).collect()} == {"202312", "202402"}
    assert files.without_month(log, "202401").count() == 2
    assert files.compact_log(log.unionByName(log.withColumn("processado_em", F.lit("2")))).select("processado_em").distinct().collect()[0][0] == "2"
    assert files.latest_log_row(log, "202402").count() == 1


def test_stream(spark, folder, tmp_path):
    src, table, mark = tmp_path / "s", str(tmp_path / "t"), str(tmp_path / "c")
    src.mkdir()
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in HEAD.split("|")])
    put(src, "Interrupcoes_IQS_20240115120000_CSL.CSV", ["1|P|10|a|1", "2|P|10|b| ", "1|P|10|c|1"])
    live.load_arriving(spark, str(src), table, mark, schema=schema).awaitTermination()
    put(src, "Interrupcoes_IQS_20240116120000_NRT.CSV", ["1|P|10|d|1", "3|P|10|e|1"])
    put(src, "Interrupcoes_IQS_20240216120000_NRT.CSV", ["1|P|10|f|1"])
    live.load_arriving(spark, str(src), table, mark, schema=schema).awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert sorted((str(r.anomes), r.NUM_INTRP_UCI) for r in rows) == [("202401", "1"), ("202401", "2"), ("202401", "3"), ("202402", "1")]
    assert {r.REGIONAL_ORIGEM for r in rows} == {"CSL", "NRT"}


def test_stream_reads_like_the_batch_load(spark, tmp_path):
    """Columns in another order, code page 1252 and bad lines."""
    from pyspark.sql import types as T
    src, table, mark = tmp_path / "s", str(tmp_path / "t"), str(tmp_path / "c")
    src.mkdir()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in HEAD.split("|")])
    put(src, "Interrupcoes_IQS_20240115120000_CSL.CSV", ["10|1|P"], head="NUM_UC_UCI|NUM_INTRP_UCI|NUM_POSTO_UCI")
    put(src, "Interrupcoes_IQS_20240116120000_NRT.CSV", ["2|P|10|Ç – “x”|1", "3|P|10|a|1|sobra"], "cp1252")
    put(src, "Interrupcoes_IQS_20240117120000_NRT.CSV", ["4|P|10"], head="a|b|c")
    for _ in range(2):
        live.load_arriving(spark, str(src), table, mark, schema=schema).awaitTermination()
    rows = {r.NUM_INTRP_UCI: r for r in spark.read.parquet(table).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].NUM_UC_UCI == "10" and rows["1"].NUM_POSTO_UCI == "P" and rows["2"].DESC_INTRP == "Ç – “x”"
    assert [r.linha for r in spark.read.parquet(table + "_rejeitadas").collect()] == ["3|P|10|a|1|sobra"]


def test_a_file_without_header_fails_alone(spark, folder, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    put(folder, "Interrupcoes_IQS_20240118120000_LES.CSV", ["50|P|1"], head="a|b|c")
    put(folder, "Interrupcoes_IQS_20240119120000_LES.CSV", ["51|P|1|ok|1", "52|P|1|sobra|1|2|3"])
    first = {r.arquivo_nome[17:25]: r for r in ingest.ingest(spark, folder, table, log, "r1", min_anomes="202401").collect()}
    assert (first["20240118"].status, first["20240118"].mensagem_erro) == ("erro", "sem cabecalho")
    assert first["20240115"].status == "processado"
    rows = sorted(map(tuple, spark.read.parquet(table).select("NUM_INTRP_UCI", "DESC_INTRP").collect()), key=str)
    rejects = spark.read.parquet(table + "_rejeitadas").select("linha").collect()
    again = ingest.ingest(spark, folder, table, log, "r2", min_anomes="202401").collect()
    # The failed files are tried again and change nothing.
    assert {r.arquivo_nome[17:25] for r in again} == {"20240118", "20240119"}
    assert sorted(map(tuple, spark.read.parquet(table).select("NUM_INTRP_UCI", "DESC_INTRP").collect()), key=str) == rows
    assert spark.read.parquet(table + "_rejeitadas").select("linha").collect() == rejects == [("52|P|1|sobra|1|2|3",)]


def test_bad_lines_do_not_depend_on_the_columns_read(spark, tmp_path):
    put(tmp_path, "Interrupcoes_IQS_20240115120000_CSL.CSV", ["1|P|10|a|1", "2|P|11|a|1|sobra"])
    rows = files.read_outage_files(spark, [str(tmp_path)])
    assert [r[0] for r in files.good_rows(rows).select("NUM_UC_UCI").collect()] == ["10"]
    assert files.good_rows(rows).count() == 1 and files.bad_rows(rows).count() == 1


def test_the_text_is_read_once(spark, folder, tmp_path, monkeypatch):
    """Whatever the number of headers and encodings, the files are scanned a single time."""
    put(folder, "Interrupcoes_IQS_20240117120000_LES.CSV", ["77|8|R"], head="NUM_UC_UCI|NUM_INTRP_UCI|NUM_POSTO_UCI")
    scans = []
    scan = files.scan_lines
    monkeypatch.setattr(files, "scan_lines", lambda *a: scans.append(1) or scan(*a))
    rows = files.read_outage_files(spark, paths(spark, folder))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 7 and scans == [1] and "FileScan text" not in plan and "FileScan csv" not in plan
    ingest.ingest(spark, folder, str(tmp_path / "t"), str(tmp_path / "log"), "r1")
    assert scans == [1, 1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_neither_sorted_nor_exchanged(spark, folder):
    """Files are told apart by counts and a look-up: the text of a line stays in the task that reads it."""
    put(folder, "Interrupcoes_IQS_20240118120000_LES.CSV", ["60|P|1|NUM_INTRP_UCI NUM_POSTO_UCI NUM_UC_UCI|1", HEAD, "61|P|1|ação|1"], "cp1252")
    lines = files.stage_lines(spark, paths(spark, folder))
    kinds = files.classify(lines)
    per_line = [x for x in plan_of(kinds).splitlines() if "indefinido" in x]
    assert any("HashAggregate" in x for x in per_line) and not any("Sort" in x for x in per_line)
    plan = plan_of(files.parse_lines(spark, lines, kinds))
    assert "BroadcastHashJoin [arquivo_path" in plan and "SortMergeJoin [arquivo_path" not in plan
    assert not any("linha" in x for x in plan.splitlines() if "Exchange" in x)
    # The names of the key within a value make no header; a header that comes again is no row.
    text = {r.NUM_INTRP_UCI: r.DESC_INTRP for r in files.read_outage_files(spark, paths(spark, folder)).collect()}
    assert text["60"] == "NUM_INTRP_UCI NUM_POSTO_UCI NUM_UC_UCI" and text["61"] == "ação" and "NUM_INTRP_UCI" not in text


def test_lines_that_look_odd(spark, tmp_path):
    """A byte order mark, quotes, carriage returns, blank lines, a header that is not the first line, accents in a header."""
    head = "NUM_INTRP_UCI|NUM_POSTO_UCI|NUM_UC_UCI|Descrição"
    (tmp_path / "Interrupcoes_IQS_20240115120000_CSL.CSV").write_bytes(("\ufeffDESC|" + head + "\r\nx|1|P|10|\"a|b\"\r\n\r\n  \r\ny|2|P||\"\"\r\n").encode())
    (tmp_path / "Interrupcoes_IQS_20240116120000_CSL.CSV").write_bytes(("preâmbulo\n" + head + "\n3|P|10|é\n").encode("cp1252"))
    rows = files.read_outage_files(spark, [str(tmp_path)])
    got = {r.NUM_INTRP_UCI: (r.DESC, r["Descrição"], r.NUM_UC_UCI) for r in files.good_rows(rows).collect()}
    assert got == {"1": ("x", "a|b", "10"), "2": ("y", None, None), "3": (None, "é", "10")}
    assert [r.linha for r in files.bad_rows(rows).collect()] == ["preâmbulo"]


def test_a_folder_of_empty_files(spark, tmp_path):
    (tmp_path / "Interrupcoes_IQS_20240115120000_CSL.CSV").write_bytes(b"")
    assert files.read_outage_files(spark, [str(tmp_path)]).count() == 0


def test_closing_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A|B\n1|2\n")
    (tmp_path / "b.csv").write_text("B|A\n3|4\n")
    got = {r.arquivo_origem: (r.A, r.B) for r in files.read_closing(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("1", "2"), "b.csv": ("4", "3")}
    (tmp_path / "c.csv").write_text("A|B\n5|6|7\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_closing(spark, str(tmp_path)).collect()


def test_a_rewrite_is_published_only_with_all_rows(spark, tmp_path):
    from vigilia.plans import marts
    path = str(tmp_path / "m")
    spark.range(10).write.parquet(path)
    assert marts.publish_rewrite(spark, path, lambda d: d.where("id > 0"))["status"] == "erro"
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 10
    done = marts.publish_rewrite(spark, path, lambda d: d.withColumn("x", F.lit(1)))
    assert done == {"antes": 10, "depois": 10, "igual": True, "status": "atualizado"}
    assert spark.read.parquet(path).columns == ["id", "x"] and spark.read.parquet(path).count() == 10


def test_log_rows(spark):
    log = spark.createDataFrame([("202401", "1", None, "a"), ("202401", "2", "9", "b"), ("202401", "9", None, "a"), ("202402", "5", "5", "c")],
                                "anomes string, iniciado_em string, finalizado_em string, etapa string")
    moments = ("finalizado_em", "iniciado_em")
    assert files.latest_log_row(log, "202401", moments).first()["etapa"] == "a"
    assert [r.etapa for r in files.log_tail(log, 3, moments).collect()] == ["a", "b", "c"]


def test_export_and_closing_read(spark, tmp_path):
    names = S.EXPORT_LAYOUT
    rows = [tuple("v" for _ in names) + (r,) for r in ("CSL", "NRT", "a/b", " ", None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*names, "REGIONAL_ORIGEM"]))
    out = str(tmp_path / "out")
    sinks.export_regional(df, out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("regional_part="))
    assert parts == ["regional_part=CSL", "regional_part=NRT", "regional_part=SEM_REGIONAL", "regional_part=a_b"]
    back = files.read_closing(spark, os.path.join(out, parts[0]))
    assert back.columns == [*names, "arquivo_origem"] and back.count() == 1
    with pytest.raises(ValueError, match="PID"):
        sinks.export_layout(df.drop("PID"))
    one = str(tmp_path / "one")
    sinks.export_regional(df, one, region="NRT")
    assert [p for p in os.listdir(one) if p.startswith("regional_part=")] == ["regional_part=NRT"]


def test_packed_export_is_the_same_lines(spark, tmp_path):
    names = S.EXPORT_LAYOUT
    rows = [tuple(f"{r} ação {i}" if c == "DESC_INTRP" else "v" for c in names) + (r,) for r in ("CSL", "NRT") for i in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*names, "REGIONAL_ORIGEM"]))
    lines, size = {}, {}
    for kind in ("none", "gzip"):
        out = tmp_path / kind
        sinks.export_regional(df, str(out), compression=kind)
        found = [str(p) for p in out.rglob("part-*")]
        assert found and all(p.endswith(".csv.gz" if kind == "gzip" else ".csv") for p in found)
        size[kind] = sum(os.path.getsize(p) for p in found)
        lines[kind] = sorted(r[0] for r in files.scan_lines(spark, found).select("linha").collect())
        back = files.good_rows(files.read_outage_files(spark, found))
        assert sorted(r[0] for r in back.select("DESC_INTRP").collect()) == sorted(r[names.index("DESC_INTRP")] for r in rows)
    assert lines["gzip"] == lines["none"] and size["gzip"] < size["none"] / 2


def test_only_keys_that_may_be_staged_move(spark, tmp_path):
    """A small batch against a large table: the table's keys are filtered as they are read, and the answer is the anti-join's."""
    path = str(tmp_path / "t")
    row = "CAST(id AS STRING) AS a, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 7 AS STRING) END AS b, CAST(202401 + id % 2 AS STRING) AS anomes, id AS v"
    spark.range(0, 40000).selectExpr(*row.split(", ")).write.partitionBy("anomes").parquet(path)
    batch = spark.range(39900, 40100).selectExpr(*row.split(", "))
    staged = batch.unionByName(batch.withColumn("v", F.col("v") + 1))
    table = spark.read.parquet(path)
    out = ingest.new_rows(staged, table, ["a", "b"])
    got = sorted((r.a, r.b or "", r.anomes) for r in out.collect())
    assert got == sorted((str(i), "" if i % 5 == 0 else str(i % 7), str(202401 + i % 2)) for i in range(40000, 40100)) and out.columns == staged.columns
    first = ingest.new_rows(staged, None, ["a", "b"]).where("CAST(a AS INT) >= 40000")
    assert sorted(map(str, out.collect())) == sorted(map(str, first.select(*out.columns).collect()))
    assert "LeftSemi" in plan_of(out) and "LeftAnti" not in plan_of(out)
    known = table.withColumn("anomes", F.col("anomes").cast("string")).select("anomes", "a", "b")
    moved = ingest._perhaps_staged(known, staged, ["anomes", "a", "b"], 400)
    assert 100 <= moved.count() < 2000 and moved.join(batch, ["anomes", "a"], "left_semi").count() == 100
    # Too many rows for that: every key of the table takes part.
    few, ingest.FEW_ROWS = ingest.FEW_ROWS, 10
    try:
        assert sorted(map(str, ingest.new_rows(staged, table, ["a", "b"]).collect())) == sorted(map(str, out.collect()))
    finally:
        ingest.FEW_ROWS = few


def test_month_tables(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("202401", 1), ("202402", 2)], "anomes string, n int")
    sinks.write_month(df, path)
    sinks.write_month(df.where("anomes = '202402'").withColumn("n", F.lit(9)), path)
    rows = spark.read.parquet(path)
    assert sorted(r.n for r in rows.collect()) == [1, 9]
    assert [r.n for r in sinks.current_month(rows).collect()] == [9]
    snap = str(tmp_path / "snap")
    sinks.snapshot_once(df, snap)
    sinks.snapshot_once(df.limit(0), snap)
    assert spark.read.parquet(snap).count() == 2
    inv = files.inventory(spark, {"mes": path}).collect()
    assert {r.anomes for r in inv} == {"202401", "202402"} and all(r.tamanho_bytes > 0 for r in inv)


def test_month_files_by_name(spark, tmp_path):
    for m in ("202401", "202402"):
        spark.range(2).withColumn("c" + m, F.lit(1)).write.parquet(str(tmp_path / f"agrupamento_oms_{m}.parquet"))
    rows = files.read_months(spark, str(tmp_path / "agrupamento_oms_202401.parquet"), str(tmp_path / "agrupamento_oms_202402.parquet"))
    assert sorted({r.ANOMES_PROCESSAMENTO for r in rows.collect()}) == ["202401", "202402"]
    assert rows.where("c202402 IS NULL").count() == 2


def test_consumers(spark):
    assert files.consumer_counts(spark, 4).count() == 5
    src = spark.createDataFrame([(" csl ", "10", "1"), ("NRT", "x", "2")], "`Região` string, `Qtd Consumidores` string, `Mês` string")
    assert [(r.regional, r.consumidores) for r in files.consumer_counts(spark, 1, src).collect()] == [("CSL", 10.0)]
    assert files.consumer_counts(spark, 7, src).count() == 2
    with pytest.raises(ValueError):
        files.consumer_counts(spark, 1, src.drop("Região"))


def test_month_params(spark):
    p = files.month_params("202412")
    assert (p["inicio"], p["proximo"]) == ("2024-12-01", "2025-01-01")
    assert spark.sql("SELECT :anomes AS a, date(:proximo) AS b", args=p).first()[0] == "202412"


def test_a_publish_that_dies_half_way(spark, tmp_path):
    """Parts of a new state, and a commit cut short, are never seen; the next publish goes on from the old state."""
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    held = table.publish(spark.range(10))
    table.prepare(spark.range(99))
    (tmp_path / "t" / "_commits" / "0000000002").write_text("v-cut")
    assert table.read().count() == 10 and [n for n, _ in table.commits()] == [1]
    # The new state is read from the old one, in one job.
    assert table.publish(table.read().where("id > 2")).count() == 7 and table.commits()[0][0] == 3
    assert held.count() == 10
    assert len(table.release(keep=2)) == 1 and held.count() == 10
    assert len(table.release()) == 1 and table.read().count() == 7 and [n for n, _ in table.commits()] == [3]
