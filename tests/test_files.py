"""Delimited files and column validation (F-10, F-11, G-10)."""

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from fieldlens.plans import jobs
from fieldlens.sources import files


def test_f10_required_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, B int, C int")
    assert files.require_columns(df, ["A", "B"]) is df
    with pytest.raises(files.MissingColumnsError) as e:
        files.require_columns(spark.createDataFrame([(1,)], "A int"), ["A", "B", "C"])
    assert "B" in str(e.value) and "C" in str(e.value)
    empty = spark.createDataFrame([], T.StructType([]))
    assert files.require_columns(empty, ["A", "B"]) is empty
    assert files.require_columns(None, ["A"]) is None


def test_f11_table_validators(spark):
    t = spark.createDataFrame([("1", "1", "ABERTO", "X")], "SS string, Tarefa string, Status string, Chassi string")
    files.require_columns(t, files.TICKET_COLUMNS, "chamados")
    files.require_columns(spark.createDataFrame([("1", 365)], "NUM_SERIAL string, GARANTIA int"), files.UNIT_COLUMNS)
    files.require_columns(spark.createDataFrame([("1",)], "SS string"), files.ERROR_COLUMNS)
    with pytest.raises(files.MissingColumnsError):
        files.require_columns(spark.createDataFrame([("1",)], "SS string"), files.TICKET_COLUMNS, "chamados")


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_g10_bom_short_long_rows(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "a.csv"),
               "﻿ SS ;Valor ;Nome\n1;1,5;Ana\n2;2\n3;3,0;Bia;extra\n4;4,25;Caio\n".encode("utf-8"))
    df = files.read_delimited(spark, p)
    assert df.columns == ["SS", "Valor", "Nome"]
    rows = sorted((r["SS"], r["Valor"], r["Nome"]) for r in df.collect())
    assert rows == [("1", "1,5", "Ana"), ("2", "2", None), ("4", "4,25", "Caio")]


def test_g10_latin1_fallback(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "b.csv"), "SS;Cidade\n1;São Paulo\n2;Goiânia\n".encode("latin-1"))
    df = files.read_with_fallback(spark, p)
    assert sorted(r["Cidade"] for r in df.collect()) == ["Goiânia", "São Paulo"]


def test_header_repair_and_allow_list(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`﻿ a ` int, ` b` int, c int")
    fixed = files.repair_headers(df, upper=True)
    assert fixed.columns == ["A", "B", "C"]
    assert files.select_allowed(fixed, [" a", "C "]).columns == ["A", "C"]
    assert files.select_allowed(fixed, ["zzz"]).columns == ["A", "B", "C"]


def test_union_and_error_base(spark):
    a = spark.createDataFrame([("1", "x", "k")], "SS string, A string, ONLY_A string")
    b = spark.createDataFrame([("2", "y")], "SS string, A string")
    assert files.union_common(a, b).columns == ["SS", "A"]
    assert files.union_all_columns(a, b).count() == 2
    e = spark.createDataFrame([(" 1 ", " tipo ", "1,5", None), (" 1 ", " tipo ", "1,5", None)],
                              "SS string, TIPO_ERRO string, VALOR_TOTAL string, VALOR_PECA string")
    r = files.clean_error_base(e).collect()
    assert len(r) == 1 and r[0]["SS"] == "1" and r[0]["TIPO_ERRO"] == "TIPO" and r[0]["VALOR_TOTAL"] == 1.5
    assert r[0]["VALOR_PECA"] == 0.0


def test_lookup_last_wins_and_export(spark, tmpdir_path):
    df = spark.createDataFrame([("I1", "a"), ("I1", "b"), ("I2", None), (None, "c")], "ITEM string, GARANTIA string")
    out = {r["ITEM"]: r["GARANTIA"] for r in files.load_lookup(df.coalesce(1)).collect()}
    assert out == {"I1": "b"}
    path = files.export_by_origin({"chamados": spark.createDataFrame([("1",)], "SS string"),
                                   "fechados": spark.createDataFrame([("2",)], "SS string")},
                                  os.path.join(tmpdir_path, "export"))
    assert sorted(os.listdir(path))[-2:] == ["origin=chamados", "origin=fechados"]


def test_s7_merged_ticket_files(spark, tmpdir_path):
    import datetime as dt

    from fieldlens.plans import jobs
    open_csv = ("SS;Tarefa;Chassi;Data;Resolvido;Status;Proprietário;Mantenedor;Serviço;Tipo;Sumário;RTM;Extra\n"
                "1;1;123.0;05/01/2025;;ABERTO;O;Sup A;PARTIDA INICIAL;A;[x] y;com rtm;e\n"
                "2;1; 9 ;03/01/2025;04/01/2025;FECHADO;F;Sup B;CORRETIVA;N;nada;;e\n")
    closed_csv = ("SS;Tarefa;Chassi;Data;Resolvido;Status;Proprietário;Mantenedor;Serviço;Tipo;Sumário;RTM\n"
                  "1;1;123;01/01/2025;02/01/2025;FECHADO;O;Sup A;PARTIDA INICIAL;A;[x] y;;\n")
    a = _write(os.path.join(tmpdir_path, "chamados.csv"), open_csv.encode("utf-8"))
    b = _write(os.path.join(tmpdir_path, "fechados.csv"), closed_csv.encode("utf-8"))
    dim = spark.createDataFrame([("Sup A", "SAW-A")], "raw string, label string")
    owner = spark.createDataFrame([("O", "OWNER")], "raw string, label string")
    t = jobs.load_ticket_files(spark, a, b, dt.date(2025, 1, 10), dim, dim, owner)
    rows = {r["SS"]: r for r in t.collect()}
    assert set(rows) == {"1", "2"} and "EXTRA" not in t.columns
    assert rows["1"]["STATUS"] == "ABERTO" and rows["1"]["AGING"] == 5      # latest extract wins, open to as_of
    assert rows["1"]["CHASSI"] == "123" and rows["1"]["RTM"] == "SIM" and rows["1"]["MANTENEDOR"] == "SAW-A"
    assert rows["2"]["CHASSI"] == "9" and rows["2"]["MANTENEDOR"] == "" and rows["2"]["TAGS"] == ["Sem Tags"]


def test_table_profile_exact_and_approximate(spark):
    from fieldlens.operators import profile
    df = spark.range(1000).selectExpr("id", "id % 10 AS k", "CASE WHEN id % 2 = 0 THEN NULL ELSE 'x' END AS s")
    exact = {r["coluna"]: (r["tipo"], r["nulos"], r["distintos"]) for r in profile.table_profile(df).collect()}
    assert exact == {"id": ("bigint", 0, 1000), "k": ("bigint", 0, 10), "s": ("string", 500, 1)}
    approx = {r["coluna"]: r["distintos"] for r in profile.table_profile(df, exact=False).collect()}
    assert approx["k"] == 10 and abs(approx["id"] - 1000) <= 50


def test_files_of_several_encodings_and_headers(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "mixed")
    os.makedirs(folder)
    _write(os.path.join(folder, "a.csv"), "\ufeffSS; Cidade\n1;São Paulo\n2;Ã©\n3\n4;x;too long\n".encode("utf-8"))
    _write(os.path.join(folder, "b.csv"), "SS; Cidade\n5;Goiânia\n".encode("latin-1"))
    # valid UTF-8 in one line does not make a Latin-1 file one: the whole file decides
    _write(os.path.join(folder, "c.csv"), b"Cidade;SS;Extra\n\xc3\xa9;6;\"q;r\"\n\xe9;7;\n")
    _write(os.path.join(folder, "d.csv"), b"")
    df = files.read_any_encoding(spark, folder, order="ordem")
    assert set(df.columns) == {"SS", "Cidade", "Extra", "ordem"}
    got = sorted((r["SS"], r["Cidade"], r["Extra"]) for r in df.collect())
    assert got == [("1", "São Paulo", None), ("2", "Ã©", None), ("3", None, None), ("5", "Goiânia", None),
                   ("6", "Ã©", "q;r"), ("7", "é", None)]
    typed = files.read_any_encoding(spark, folder, T.StructType([T.StructField("SS", T.IntegerType()), T.StructField("Nada", T.StringType())]))
    assert sorted(r["SS"] for r in typed.where("Nada IS NULL").collect()) == [1, 2, 3, 5, 6, 7]
    flags = {os.path.basename(r["_file"]): r["_utf8"] for r in files.file_encodings(spark, folder).collect()}
    assert flags == {"a.csv": True, "b.csv": False, "c.csv": False}
    last = files.load_lookup(df, "Cidade", "SS", "ordem")
    assert {r["Cidade"]: r["SS"] for r in last.collect()}["Ã©"] == "6"


def test_ticket_and_unit_files(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "open.csv"),
               "SS;Tarefa;Status;Chassi;Data;Resolvido;Mantenedor;RTM;Só aqui\n1;1;ABERTO;10.0;01-02-2024;;José;x;y\n".encode("latin-1"))
    b = _write(os.path.join(tmpdir_path, "closed.csv"),
               "SS;Tarefa;Status;Chassi;Data;Resolvido;Mantenedor;RTM\n1;1;FECHADO;10;2024/01/31;01/02/24;José;com rtm\n".encode("utf-8"))
    names = spark.createDataFrame([("José", "SAW")], "raw string, label string")
    t = jobs.load_ticket_files(spark, a, b, dt.date(2024, 3, 1), names, names, names).collect()
    assert [(r["SS"], r["CHASSI"], r["STATUS"], r["MANTENEDOR"], r["DATA"].date()) for r in t] == [("1", "10", "ABERTO", "SAW", dt.date(2024, 2, 1))]
    broken = _write(os.path.join(tmpdir_path, "broken.csv"), b"SS;Data\n1;01/02/2024\n")
    with pytest.raises(files.MissingColumnsError):
        files.load_ticket_files(spark, broken)
    u = _write(os.path.join(tmpdir_path, "units.csv"), (
        "Serial;GARANTIA ;NOME_PAIS;DT_NUM_NF;SÉRIE;Outra;outra\n"
        " s1 ;365,0;brasil;15.03.2023;w7hx2-1;z;\ns2;365.9; Brasil ;15/03/24;W7HX2-2;z;\ns3;1;CHILE;15/03/2024;W7HX2-3;z;\n"
        "s4;1;BRASIL;x;ZZZ-1;z;\n").encode("latin-1"))
    units = jobs.load_unit_files(spark, u, dt.date(2024, 6, 1), drop_other_models=False)
    assert "Outra" not in units.columns
    rows = {r["NUM_SERIAL"]: (r["GARANTIA"], r["ANO_NF"], r["STATUS_GARANTIA"]) for r in units.collect()}
    assert rows == {"S1": (0, 2023, "FORA"), "S2": (365, 2024, "DENTRO"), "S4": (1, None, "")}


def test_model_from_the_first_column_there_is(spark):
    base = "DT_NUM_NF date, GARANTIA string"
    row = (dt.date(2024, 1, 1), "365")
    model = lambda names: jobs.process_installed_base(
        spark.createDataFrame([row + tuple(v for _, v in names)], base + "".join(f", `{n}` string" for n, _ in names)),
        dt.date(2024, 2, 1), domestic_only=False, drop_other_models=False).first()["MODELO"]
    known = model([("ITEM", "W7HX2-1")])
    assert known != "OUTROS"
    assert model([("SERIE", "W7HX2-1")]) == known and model([("SÉRIE", "x-1"), ("SERIE", "W7HX2-1")]) == "OUTROS"
    assert model([("NUM_SERIAL", "W7HX2-1"), ("NUM_SERIE", "x")]) == known and model([("CLIENTE", "W7HX2-1")]) == ""


def test_domestic_by_country_name(spark):
    from fieldlens.operators import filters
    df = spark.createDataFrame([("BRASIL",), (" brasil\t",), ("CHILE",), (None,)], "NOME_PAIS string")
    assert filters.domestic_only(df).count() == 2


def test_lookups_are_appended_and_the_last_one_counts(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "cache")
    files.write_lookup(spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3")], "ITEM string, GARANTIA string"), path)
    files.write_lookup(spark.createDataFrame([("a", "9")], "ITEM string, GARANTIA string"), path)
    got = files.load_lookup(spark.read.parquet(path), order="LIDO_EM")
    assert sorted(map(tuple, got.collect())) == [("a", "9"), ("b", "2")]


def test_unpacking_repeats_what_a_dead_run_left(spark, tmpdir_path, monkeypatch):
    from fieldlens.streaming.published import Published
    lines = spark.createDataFrame([("1", "1", "A", "01/02/2024", "k1"), ("1", "2", "B", "01/02/2024", "k2"), ("1", "3", "C", "01/02/2020", "k1"),
                                   ("2", "1", "D", "01/02/2024", "k4")], "PEDIDO string, LINHA string, ITEM string, DT_NUM_NF string, key string")
    html = '<table border="1"><tr><th>S</th></tr>{}</table>'
    row = lambda s: f"<tr><td>{s}</td></tr>"
    page = lambda *rows: spark.createDataFrame(list(rows), "page_key string, html string")
    pages = page(("k1", html.format(row("s1") + row("s2"))), ("k2", html.format("")))
    root = os.path.join(tmpdir_path, "unpacked")
    run = lambda p: jobs.run_unpack(spark, root, lines, p, "key", 2024)
    schema = T.StructType([*lines.drop("key").schema.fields, T.StructField("Serial", T.StringType())])
    have = lambda: sorted((r["PEDIDO"], r["LINHA"], r["Serial"]) for r in jobs.unpacked_rows(spark, root, schema).collect())
    with monkeypatch.context() as m:
        m.setattr(Published, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(pages)
    assert have() == []
    assert run(pages) == 1 and have() == [("1", "1", "s1"), ("1", "1", "s2"), ("1", "2", "")]
    assert run(pages) == 1 and len(have()) == 3  # nothing new, no version
    # the page of the last line comes later; the others are done
    assert run(page(("k4", html.format(row("s4"))), ("k1", html.format(row("zz"))))) == 2
    assert have() == [("1", "1", "s1"), ("1", "1", "s2"), ("1", "2", ""), ("2", "1", "s4")]
