"""The canonical relational model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"l": "long", "i": "int", "s": "string", "m": "decimal(18,2)", "q": "decimal(18,3)", "u": "decimal(18,4)", "d": "double", "t": "timestamp"}


def _fields(kind: str, names: str) -> list[tuple[str, str]]:
    return [(n, _KINDS[kind]) for n in names.split()]


def _parties(*suffixes: str) -> str:
    return " ".join(f"{p}_{s}" for p in ("emitente", "destinatario") for s in suffixes)


# Tables and columns of the data contract.
TABLES: dict[str, list[tuple[str, str]]] = {
    "documentos": _fields("l", "id")
    + _fields("s", "nome_arquivo tipo origem hash chave_acesso status data_upload data_emissao")
    + _fields("s", _parties("cnpj", "cpf", "nome", "ie", "im", "uf", "municipio", "endereco"))
    + _fields("s", _parties("logradouro", "numero", "complemento", "bairro", "cep"))
    + _fields("s", "numero_nota serie modelo")
    + _fields("m", "valor_total total_produtos total_servicos valor_descontos valor_frete valor_seguro valor_outros valor_liquido total_icms total_ipi total_pis total_cofins")
    + _fields("s", "modalidade_frete placa_veiculo uf_veiculo")
    + _fields("q", "peso_bruto peso_liquido qtd_volumes")
    + _fields("s", "forma_pagamento")
    + _fields("m", "valor_pagamento troco")
    + _fields("s", "caminho_arquivo caminho_xml versao_schema ambiente protocolo_autorizacao data_autorizacao cstat xmotivo responsavel_tecnico ocr_tipo motivo_rejeicao meta_json"),
    "documentos_detalhes": _fields("l", "id documento_id") + _fields("s", "chave valor origem") + _fields("t", "criado_em"),
    "itens": _fields("l", "id documento_id") + _fields("i", "numero_item") + _fields("s", "descricao ean ncm cest cfop") + _fields("q", "quantidade") + _fields("s", "unidade") + _fields("u", "valor_unitario") + _fields("m", "valor_total desconto outras_despesas") + _fields("s", "codigo_produto"),
    "impostos": _fields("l", "id item_id") + _fields("s", "tipo_imposto cst origem") + _fields("m", "base_calculo") + _fields("u", "aliquota") + _fields("m", "valor"),
    "extracoes": _fields("l", "id documento_id") + _fields("s", "agente") + _fields("d", "confianca_media") + _fields("s", "texto_extraido linguagem") + _fields("d", "tempo_processamento") + _fields("t", "criado_em"),
    "revisoes": _fields("l", "id documento_id") + _fields("s", "campo valor_anterior valor_corrigido usuario") + _fields("t", "data_revisao"),
    "usuarios": _fields("l", "id") + _fields("s", "nome email perfil senha_hash"),
    "metricas": _fields("l", "id") + _fields("s", "tipo_documento") + _fields("d", "acuracia_media taxa_revisao taxa_erro tempo_medio") + _fields("s", "meta_json") + _fields("t", "registrado_em"),
    "logs": _fields("l", "id") + _fields("s", "evento usuario detalhes") + _fields("t", "criado_em"),
    "memoria": _fields("l", "id") + _fields("s", "pergunta resposta_resumo") + _fields("d", "duracao_s") + _fields("t", "criado_em"),
    "config": _fields("l", "id") + _fields("s", "chave valor usuario"),
    "ncm_catalogo": _fields("s", "codigo descricao"),
    "rag_chunks": _fields("l", "id documento_id") + _fields("s", "source chunk embedding_json") + _fields("t", "criado_em"),
    "metricas_agente": _fields("l", "id doc_id") + _fields("s", "agente tipo_documento") + _fields("d", "coverage precision recall confidence latency_s") + _fields("l", "tp fp fn") + _fields("s", "extras"),
}

#: Child table -> (column, parent table): rows go with their parent.
PARENTS = {
    "documentos_detalhes": ("documento_id", "documentos"),
    "itens": ("documento_id", "documentos"),
    "extracoes": ("documento_id", "documentos"),
    "revisoes": ("documento_id", "documentos"),
    "rag_chunks": ("documento_id", "documentos"),
    "impostos": ("item_id", "itens"),
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in TABLES[table]))


def dropped_columns(df: DataFrame, table: str) -> list[str]:
    """Columns that the table doesn't have and conform therefore leaves out."""
    known = {n for n, _ in TABLES[table]}
    return sorted(c for c in df.columns if c not in known)


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns and types: unknown columns go, missing ones are null, nested values become JSON."""
    kinds = dict(df.dtypes)
    out = []
    for name, kind in TABLES[table]:
        if name not in kinds:
            out.append(F.lit(None).cast(kind).alias(name))
        elif kinds[name].startswith(("array", "map", "struct")):
            out.append(F.to_json(name).alias(name))
        elif kinds[name] == kind:
            out.append(F.col(name))
        else:
            out.append(F.col(name).try_cast(kind).alias(name))
    return df.select(*out)


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a null column for each name that it lacks."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in columns.items() if c not in df.columns})


def schema_fingerprint(tables: dict[str, DataFrame]) -> str:
    """A short name of the tables' columns, whatever their order."""
    import hashlib

    text = json.dumps([f"{t}:{','.join(sorted(df.columns))}" for t, df in sorted(tables.items())])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))
