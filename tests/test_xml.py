from __future__ import annotations

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tributo.functions import text
from tributo.sources import folder, ingest, xml

from . import xml_samples as S


def _fields(content):
    return xml.read_document(content.encode() if isinstance(content, str) else content)


def test_kinds():
    want = {"NFE": "NFe", "NFCE": "NFCe", "CTE_OK": "CTe", "MDFE": "MDF-e", "CFE": "CF-e", "NFSE_ABRASF": "NFSe", "NFSE_NACIONAL": "NFSe", "GENERIC": "xml/desconhecido", "PREFIXED": "NFCe"}
    assert {n: _fields(getattr(S, n))["kind"] for n in want} == want


def test_nfe_fields_and_taxes():
    d = _fields(S.NFE)
    f = d["fields"]
    assert f["numero_nota"] == "123" and f["emitente_uf"] == "SP" and f["valor_total"] == "53.05" and f["placa_veiculo"] == "ABC1D23"
    assert f["forma_pagamento"] == "17" and f["protocolo_autorizacao"] == "135" and f["versao_schema"] == "4.00"
    kinds = [[t["tipo_imposto"] for t in i["taxes"]] for i in d["items"]]
    assert kinds == [["ICMS", "FCP", "IPI", "PIS", "COFINS"], ["ICMS"]]
    assert d["items"][1]["taxes"][0]["valor"] == "5.40" and d["extras"] == {"det/0/CFOP": "5102"}


def test_party_fallbacks():
    only = _fields(S.CTE_REM_ONLY)["fields"]
    assert only["destinatario_nome"] == "Remetente" and only["destinatario_uf"] == "PR" and only["qtd_volumes"] == "12"
    assert _fields(S.CTE_OK)["fields"]["destinatario_uf"] == "SC"
    assert _fields(S.MDFE)["fields"]["chave_acesso"] == S.KEY and _fields(S.MDFE)["fields"]["data_emissao"] == "2024-04-02"


def test_childless_element_counts_as_missing():
    taxes = _fields(S.EMPTY_ICMS)["items"][0]["taxes"]
    assert [(t["tipo_imposto"], t["valor"]) for t in taxes] == [("ICMS", "0.70")]


@pytest.mark.parametrize("content", [S.MALFORMED, S.ENTITIES, b"", b"%PDF-1.4"])
def test_invalid_is_named(content):
    d = xml.read_document(content)
    assert d["kind"] == "xml/invalido" and d["error"]


def test_latin1_is_read_again():
    assert _fields(S.LATIN1)["fields"]["emitente_nome"] == "Padaria São João"


def _files(spark, *named):
    rows = [(n, f"/in/{n}", bytearray(c.encode() if isinstance(c, str) else c)) for n, c in named]
    return spark.createDataFrame(rows, "nome_arquivo string, caminho_arquivo string, content binary").withColumn("hash", F.sha2("content", 256))


def test_ingest(spark):
    files = _files(spark, ("a.xml", S.NFE), ("again.xml", S.NFE), ("b.XML", S.CFE), ("c.xml", S.MALFORMED), ("d.pdf", b"%PDF"), ("e.xml", S.NFSE_ABRASF), ("f.xml", S.NFSE_NACIONAL))
    out = ingest.ingest(files, day="2024-08-01")
    docs = {r.nome_arquivo: r for r in out["documentos"].collect()}
    assert len(docs) == 6 and docs["d.pdf"].tipo == "pdf" and docs["d.pdf"].status == "quarentena"
    assert docs["c.xml"].status == "quarentena" and docs["c.xml"].tipo == "xml/invalido"
    nfe = docs.get("a.xml") or docs["again.xml"]
    assert nfe.valor_total == Decimal("53.05") and nfe.chave_acesso == S.KEY and nfe.emitente_nome == "Casa Exemplo LTDA" and nfe.data_emissao == "2024-01-05"
    assert nfe.emitente_endereco == "Rua A, 10, Centro, Santos, SP, 11010000"
    assert docs["b.XML"].valor_pagamento == Decimal("10.00") and docs["b.XML"].forma_pagamento == "01" and docs["b.XML"].troco == Decimal("1.50")
    assert docs["e.xml"].emitente_uf == "SP" and docs["e.xml"].total_servicos == Decimal("200.00") and docs["f.xml"].emitente_uf == "RJ"
    items = out["itens"].where(F.col("documento_id") == nfe.id).orderBy("numero_item").collect()
    assert [(i.numero_item, i.valor_total) for i in items] == [(1, Decimal("21.00")), (2, Decimal("30.00"))]
    assert out["impostos"].join(out["itens"].select(F.col("id").alias("item_id"), "documento_id"), "item_id").where(F.col("documento_id") == nfe.id).count() == 6
    assert out["documentos_detalhes"].where("chave = 'natureza_operacao'").first().valor == "Venda  de mercadoria"
    again = ingest.ingest(files, out["documentos"])
    assert again["documentos"].count() == 0
    anew = ingest.reprocess(files, out["documentos"].where("tipo = 'CF-e'"))
    assert [(r.nome_arquivo, r.origem, r.id) for r in anew["documentos"].collect()] == [("b.XML", "reprocessamento", docs["b.XML"].id)]
    assert out["extracoes"].where("tempo_processamento is null").count() == 1 and {r.tipo_documento for r in out["metricas"].collect()} >= {"NFe", "CF-e", "pdf"}
    runs = {r.doc_id: r for r in out["metricas_agente"].collect()}
    assert runs[nfe.id].latency_s > 0 and runs[nfe.id].coverage > 0.5 and "4.00" in runs[nfe.id].extras
    assert f"doc_id={nfe.id}|tipo=NFe|status=processando" in {r.detalhes for r in out["logs"].collect()}


def test_files_are_packed_by_bytes():
    sizes = [(f"f{i}", 10 << 10) for i in range(40)] + [("large", 3 << 20), ("empty", 0)]
    groups = folder.pack(sizes, 1 << 20)
    assert sorted(p for g in groups for p in g) == sorted(p for p, _ in sizes) and groups[0] == ["large"]
    cost = dict(sizes)
    assert all(sum(cost[p] + folder.OPEN_BYTES for p in g) <= 1 << 20 for g in groups[1:]) and len(groups) == 5
    assert folder.pack([], 1) == []


def test_a_folder_is_read_alike_as_batch_and_stream(spark, tmp_path):
    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    for i in range(12):
        (source / f"n{i}.xml").write_text(S.NFE.replace("<nNF>123</nNF>", f"<nNF>{i}</nNF>"))
    (source / "broken.xml").write_bytes(b"\xff<a")
    (source / "empty.xml").write_bytes(b"")
    (source / "_hidden.xml").write_text(S.CFE)
    (source / "note.txt").write_text("x")
    folder.register(spark)
    told = lambda df: sorted((r.nome_arquivo, r.hash, r.kind, r.error, tuple(sorted((r.fields or {}).items())), len(r["items"] or []), len(r.payments or [])) for r in df.collect())
    batch = spark.read.format(folder.NAME).option("pathGlobFilter", "*.xml").option("partitionBytes", 300_000).load(str(tmp_path / "in"))
    want = told(xml.parse(ingest.read_files(spark, str(tmp_path / "in")).where("nome_arquivo like '%.xml' and nome_arquivo not like '\\\\_%'")))
    # Spark's own readers pass over empty files; here one is a row, which is registered as invalid.
    assert told(batch.where("bytes > 0")) == want and len(want) == 13 and batch.rdd.getNumPartitions() > 2
    assert batch.where("bytes = 0").first().kind == "xml/invalido" and xml.documents(batch).count() == 14
    want = told(batch)

    def run():
        query = spark.readStream.format(folder.NAME).option("pathGlobFilter", "*.xml").load(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).start()
        query.processAllAvailable()
        query.stop()
        return told(spark.read.parquet(str(tmp_path / "out")))

    assert run() == want
    (source / "late.xml").write_text(S.CFE)
    assert [r[0] for r in run() if r not in want] == ["late.xml"] and len(run()) == 15
    with pytest.raises(Exception, match="path"):
        spark.read.format(folder.NAME).load().count()


def test_a_lookup_passes_over_no_other_elements(monkeypatch):
    """Elements are named a few times each, however many fields are looked up: once below the root and once as a child."""
    seen = []
    real = xml._name
    monkeypatch.setattr(xml, "_name", lambda e: seen.append(e) or real(e))
    monkeypatch.setattr(xml, "_NAMES", {}, raising=False)
    content = S.NFSE_ABRASF.replace("</CompNfse>", "<outro><a/><b/><c/></outro>" * 50 + "</CompNfse>")
    xml.read_document(content.encode())
    assert len(seen) < 4 * content.count("<")


def test_items_may_be_left_out():
    whole, rest = xml.read_document(S.NFE.encode()), xml.read_document(S.NFE.encode(), items=False)
    assert whole["items"] and rest == whole | {"items": []}


def _told(found):
    names = [c for c in found if c != "tempo"]
    return [dict(zip(names, row, strict=True)) for row in zip(*[found[c].to_pylist() for c in names], strict=True)]


def _in_full(content, items):
    doc = xml.read_document(content, items=items)
    return doc | {c: [(k, v) for k, v in doc[c].items() if v is not None] for c in ("fields", "extras")}


@pytest.mark.parametrize("items", [True, False])
def test_documents_of_one_shape_are_read_once(monkeypatch, items):
    """Later documents of a shape are what reading them in full gives, without being read."""
    samples = [v if isinstance(v, bytes) else v.encode() for v in (S.NFE, S.NFCE, S.CTE_OK, S.CFE, S.NFSE_ABRASF, S.NFSE_NACIONAL, S.GENERIC, S.PREFIXED)]
    contents = [re.sub(rb"(?<=>)([^<]*[0-9]{3})(?=<)", rb"\g<1>%d " % i, c.replace(b'Id="', b'Id="%d' % i)) if i else c for c in samples for i in range(6)]
    want = [_in_full(c, items) for c in contents]
    read = []
    real = xml.read_document
    counted = lambda content, items=True: read.append(content) or real(content, items=items)
    monkeypatch.setattr(xml, "read_document", counted)
    monkeypatch.setattr(xml, "_SHAPES", {items: xml.Shapes(lambda c: counted(c, items), lambda e: xml._name(e) in xml._DECIDING)}, raising=False)
    assert _told(xml.found(contents, items=items)) == want
    read.clear()
    assert _told(xml.found(contents, items=items)) == want and not read


def test_what_is_no_plain_text_is_read_in_full():
    doc = "<q><ide><mod>{mod}</mod></ide><emit><xNome>{a}</xNome></emit><enderEmit><xLgr>{b}</xLgr><UF>SP</UF></enderEmit><total><vNF>{c}</vNF></total></q>"
    odd = ("x", " ", "", "a &amp; b", "&#65;", "<![CDATA[<x>]]>", "u<!--c-->v", "u<?p?>v", "]]>", "\x01", "a\r\nb", "a > b", 'p="q"', "\ue0000\ue001", "\xa0", "\uffff", "<b/>c", "&x;")
    contents = [doc.format(mod=m, a=a, b=b, c="1.00").encode() for m in ("55", "65", "57", "59", "", "x") for a in odd for b in ("Rua", a)]
    contents += [c.replace(b"<q>", head) for c in contents for head in (b'<?xml version="1.0" encoding="UTF-8"?><q a="1" versao=\'4\'>', b'<?xml version="1.0" encoding="latin-1"?><q>', b'<q xmlns="">', b'<q xmlns:n="">', b'<q versao="a&lt;b">', b'<q versao="a\tb">', b'<q versao="x>y">')]
    contents += ["<q><emit><xNome>Jo\xe3o</xNome></emit></q>".encode("latin-1")] * 3
    for _ in range(2):
        assert _told(xml.found(contents * 2)) == [_in_full(c, True) for c in contents] * 2


def test_shapes_are_kept_within_bounds(monkeypatch):
    from tributo.sources import shapes

    monkeypatch.setattr(shapes, "KEPT", 4)
    monkeypatch.setattr(shapes, "SEEN", 4)
    kept = xml.Shapes(xml.read_document, lambda e: False)
    for i in range(200):
        kept.find(f"<q><a{i // 3}>x</a{i // 3}></q>".encode())
        assert len(kept.shapes) <= 4 and len(kept.seen) <= 4


def test_documents_are_written_by_more_tasks_than_the_table_has_blocks(spark, sf_dir):
    from tributo.plans import documents

    assert documents._written(spark, sf_dir, "nfe").rdd.getNumPartitions() >= 4


def test_no_method_is_too_long_to_be_compiled(spark, sf_dir):
    """The JVM interprets methods of over 8,000 bytes."""
    from tributo.plans import documents

    printer = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("xml_extract_nfe", "xml_extract_nfse", "xml_extract_nfce", "xml_extract_cfe", "xml_items", "xml_taxes"):
            plan = documents.QUERIES[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan()
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", printer.codegenString(plan))]
            assert sizes and max(sizes) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_values_not_written_plainly(value):
    texts = lambda *parts: [F.lit(p).cast("string") for p in parts]
    assert [value(text.strict_decimal(F.lit(v), 2)) for v in ("1.50", "1.234,56", " 7 ", "1 0,5", "1e2", "x", "", "12\n")] == [Decimal(v) if v else None for v in ("1.50", "1234.56", "7.00", "10.50", "100.00", None, None, "12.00")]
    assert [value(text.iso_date(F.lit(v))) for v in ("2024-01-05T10:00", "em 2024/01/05", "05/01/2024", "x", "")] == ["2024-01-05"] * 3 + [None] * 2
    assert value(text.joined_address(*texts("Rua A", "7", None, "Santos"))) == "Rua A, 7, Santos"
    assert value(text.joined_address(*texts(" Rua  A", "", " ", "\tSantos\n"))) == "Rua A, Santos"
    assert value(text.joined_address(*texts(None, None))) is None and value(text.joined_address(*texts("", " "))) is None


def test_contents_are_dealt_before_they_are_sorted(spark):
    files = _files(spark, ("a.xml", S.NFE), ("again.xml", S.NFE), ("d.pdf", b"%PDF"))
    plan = ingest.ingest(files, day="2024-08-01")["documentos"]._jdf.queryExecution().executedPlan().toString()
    below = [b for a, b in zip(plan.splitlines(), plan.splitlines()[1:]) if "Exchange hashpartitioning(hash" in a]
    assert below and not any("Aggregate" in line for line in below)


def test_known_files_are_not_hashed_where_the_table_is_read(spark, sf_dir):
    from tributo.plans import documents

    plan = documents.QUERIES["reprocessed"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and not any("sha2" in line for line in plan.splitlines() if "FileScan" in line or "Filter (" in line)
