from __future__ import annotations

from pyspark.sql import functions as F

from tributo.streaming import ingest

from . import xml_samples as S


def test_files_arrive_once(spark, tmp_path):
    source, target, mark = (tmp_path / n for n in ("in", "out", "mark"))
    source.mkdir()
    (source / "a.xml").write_text(S.NFE)
    (source / "b.xml").write_text(S.NFE)
    ingest.run_ingest(spark, str(source), str(target), str(mark), buckets=2).awaitTermination()
    (source / "c.xml").write_text(S.CFE)
    (source / "d.xml").write_text(S.NFE)
    ingest.run_ingest(spark, str(source), str(target), str(mark), buckets=2).awaitTermination()
    kinds = sorted(r.tipo for r in spark.read.parquet(f"{target}/documentos").collect())
    assert kinds == ["CF-e", "NFe"]
    assert spark.read.parquet(f"{target}/itens").count() == 3
    rows = lambda table: spark.read.parquet(f"{target}/{table}").collect()
    documents = {r.id: r for r in rows("documentos")}
    metrics = {r.id: r for r in rows("metricas")}
    assert metrics.keys() == documents.keys() and all(m.tipo_documento == documents[i].tipo and m.taxa_erro == 0.0 and 0 < m.acuracia_media <= 1 for i, m in metrics.items())
    assert all(m.registrado_em is not None and '"status_evento"' in m.meta_json for m in metrics.values())
    assert sorted((r.agente, r.doc_id, r.tipo_documento) for r in rows("metricas_agente")) == sorted(("xml_parser", d.id, d.tipo) for d in documents.values())
    assert sorted((r.evento, r.detalhes) for r in rows("logs")) == sorted(("ingestao_xml", f"doc_id={d.id}|tipo={d.tipo}|status={d.status}") for d in documents.values())
    assert {(r.documento_id, r.agente) for r in rows("extracoes")} == {(i, "xml_parser") for i in documents}
    # Both batches' hashes are in the ledger, so nothing comes in a third time.
    (source / "e.xml").write_text(S.CFE)
    ingest.run_ingest(spark, str(source), str(target), str(mark), buckets=2).awaitTermination()
    assert spark.read.parquet(f"{target}/documentos").count() == 2


def test_windowed_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:05:00", "a", 1.0, 0.0), ("2024-01-01 10:50:00", "a", 0.0, 1.0), ("2024-01-01 12:00:00", "a", 1.0, 0.0)], "t string, tipo_documento string, acuracia_media double, taxa_erro double")
    rows.withColumn("registrado_em", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("tipo_documento string, acuracia_media double, taxa_erro double, registrado_em timestamp").parquet(str(tmp_path / "m"))
    q = ingest.windowed_metrics(stream).writeStream.outputMode("append").format("memory").queryName("m").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select eventos, acuracia, erro from m order by inicio").collect()
    assert tuple(got[0]) == (2, 0.5, 0.5)
