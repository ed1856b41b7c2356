"""Field normalisation of documents and items, and the fusion of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal, text

# A canonical column and the names it may come under, in order.
ALIASES = {
    "valor_total": ("total_documento", "vtotal", "valor_nota"),
    "total_produtos": ("valor_produtos", "valor_dos_produtos", "vprod"),
    "total_servicos": ("valor_servicos", "valor_dos_servicos", "vserv"),
    "total_icms": ("valor_icms", "vicms"),
    "total_ipi": ("valor_ipi", "vipi"),
    "total_pis": ("valor_pis", "vpis"),
    "total_cofins": ("valor_cofins", "vcofins"),
    "valor_iss": ("total_iss", "viss"),
    "valor_descontos": ("desconto_total", "desconto", "vdesc"),
    "valor_outros": ("outras_despesas", "outras_desp", "voutros"),
    "valor_frete": ("frete", "vfrete"),
}
# Old names that mirror a canonical column.
MIRRORS = {
    "valor_produtos": "total_produtos", "valor_servicos": "total_servicos", "valor_icms": "total_icms", "valor_ipi": "total_ipi", "valor_pis": "total_pis",
    "valor_cofins": "total_cofins", "desconto_total": "valor_descontos", "outras_despesas": "valor_outros", "frete": "valor_frete", "total_iss": "valor_iss",
}
DATES = ("data_emissao", "data_saida", "data_recebimento", "competencia", "data_autorizacao")
VALUES = ("valor_total", "total_produtos", "total_servicos", "total_icms", "total_ipi", "total_pis", "total_cofins", "valor_iss", "valor_descontos", "valor_outros", "valor_frete", "valor_seguro", "valor_despesas_acessorias", "valor_troco")
TAX_IDS = ("emitente_cnpj", "destinatario_cnpj", "emitente_cpf", "destinatario_cpf", "cnpj_autorizado")
GENERIC = ("uf", "municipio", "endereco", "inscricao_estadual")
SWAPPED = ("nome", "cnpj", "cpf", "ie", "im", "uf", "municipio", "endereco")


def with_aliases(df: DataFrame) -> DataFrame:
    out = {}
    for name, others in ALIASES.items():
        given = [c for c in (name, *others) if c in df.columns]
        if any(c != name for c in given):
            out[name] = F.coalesce(*[F.when(~text.missing(F.col(c)), F.col(c).cast("string")) for c in given])
    return df.withColumns(out)


def with_mirrors(df: DataFrame) -> DataFrame:
    return df.withColumns({old: F.when(text.missing(F.col(old)), F.col(new)).otherwise(F.col(old)) if old in df.columns else F.col(new) for old, new in MIRRORS.items() if new in df.columns})


def _value(df: DataFrame, c: str) -> Column:
    """Numbers stay as they are, so no exponent is read twice; text is parsed."""
    return text.number_br(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")


def _swap(df: DataFrame) -> Column:
    given = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    issuer, recipient = given("emitente_nome"), given("destinatario_nome")
    no_issuer = F.coalesce(text.digits(given("emitente_cnpj")), F.lit("")) == ""
    has_recipient = F.coalesce(text.digits(given("destinatario_cnpj")), F.lit("")) != ""
    legal = fiscal.looks_legal(recipient)
    return (fiscal.looks_natural(issuer) & legal) | (no_issuer & has_recipient & legal)


def normalise(docs: DataFrame, *, drop_generic: bool = False) -> DataFrame:
    """docs with every known field in canonical form, invertido, tipo_inferido, contexto, and ajustes: the fields changed.

    A field that a table lacks is passed over. Parties are swapped back where names and ids say that they were mixed up.
    Each row is judged by itself, so rows without an id and rows that share one stay as many as they are.
    """
    given = docs.columns
    df = with_aliases(docs.withColumns({f"_b_{c}": F.col(c).cast("string") for c in given}))
    have = lambda names: [c for c in names if c in df.columns]
    steps: dict[str, Column] = {c: text.iso_date(F.col(c)) for c in have(DATES)}
    steps |= {c: _value(df, c) for c in have(VALUES)}
    steps |= {c: F.when(~text.missing(F.col(c)), text.digits(F.col(c))) for c in have(TAX_IDS)}
    steps |= {c: text.state_registration(F.col(c)) for c in have(("emitente_ie", "destinatario_ie", "inscricao_estadual"))}
    steps |= {c: text.city_registration(F.col(c)) for c in have(("emitente_im", "destinatario_im"))}
    steps |= {c: f(F.col(c)) for c, f in (("numero_nota", text.invoice_number), ("serie", text.series), ("modelo", text.model), ("chave_acesso", fiscal.key_in_digits), ("condicao_pagamento", fiscal.payment_terms), ("meio_pagamento", fiscal.payment_means), ("bandeira_cartao", fiscal.card_brand)) if c in df.columns}
    steps |= {c: F.when(~text.missing(F.col(c)), text.company_name(F.col(c))) for c in have(("emitente_nome", "destinatario_nome"))}
    steps |= {c: text.fixed_digits(F.col(c), n) for c, n in (("cfop", 4), ("ncm", 8), ("cest", 7)) if c in df.columns}
    if "municipio" in df.columns:
        steps["municipio"] = F.coalesce(fiscal.city_of(F.col("municipio")), text.blank_to_null(text.squeeze(F.col("municipio"))))
        region = F.coalesce(text.blank_to_null(F.upper(F.trim("uf"))) if "uf" in df.columns else F.lit(None), fiscal.region_of(F.col("municipio")))
        steps["uf"] = region
        if "emitente_uf" in df.columns:
            steps["emitente_uf"] = F.coalesce(text.blank_to_null(F.col("emitente_uf")), region)
    if "endereco" in df.columns:
        steps["endereco"] = text.blank_to_null(text.squeeze(F.col("endereco")))
    context = F.struct(*[F.col(c) for c in have(GENERIC)]) if have(GENERIC) else F.lit(None).cast("string")
    df = df.withColumn("contexto", context).withColumns(steps)
    pairs = [s for s in SWAPPED if f"emitente_{s}" in df.columns and f"destinatario_{s}" in df.columns]
    df = df.withColumn("invertido", _swap(df))
    a, b = (lambda s: f"emitente_{s}"), (lambda s: f"destinatario_{s}")
    df = df.withColumns({a(s): F.when(F.col("invertido"), F.col(b(s))).otherwise(F.col(a(s))) for s in pairs} | {b(s): F.when(F.col("invertido"), F.col(a(s))).otherwise(F.col(b(s))) for s in pairs})
    hints = [F.col(c) for c in ("natureza_operacao", "observacoes", "emitente_nome", "destinatario_nome") if c in df.columns]
    df = df.withColumn("tipo_inferido", fiscal.document_kind(F.col("modelo") if "modelo" in df.columns else F.lit(None).cast("string"), *hints))
    changed = [F.when(~F.col(c).cast("string").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in steps if c in given]
    df = df.withColumn("ajustes", F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>"))
    df = df.drop(*[f"_b_{c}" for c in given])
    return df.drop(*GENERIC) if drop_generic else df


def write_back(raw: DataFrame, normalised: DataFrame, fields: list[str]) -> DataFrame:
    """raw with the normalised values that aren't null; a value that normalising lost stays as it was."""
    new = normalised.select("id", *[F.col(c).cast("string").alias(f"_{c}") for c in fields])
    kinds = dict(raw.dtypes)
    return raw.join(new, "id", "left").withColumns({c: F.coalesce(F.col(f"_{c}").try_cast(kinds[c]), F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])


def normalise_items(items: DataFrame) -> DataFrame:
    steps: dict[str, Column] = {}
    for c in items.columns:
        if c == "descricao":
            steps[c] = text.blank_to_null(text.squeeze(F.col(c)))
        elif c == "unidade":
            steps[c] = text.blank_to_null(F.upper(F.trim(c)))
        elif c in ("quantidade", "valor_unitario", "valor_total", "valor_icms", "valor_ipi", "valor_pis", "valor_cofins"):
            steps[c] = _value(items, c)
        elif c.startswith("aliquota_"):
            steps[c] = text.clamp(_value(items, c), 0.0, 100.0)
        elif c in ("ncm", "cfop", "cest"):
            steps[c] = text.fixed_digits(F.col(c), {"ncm": 8, "cfop": 4, "cest": 7}[c])
        elif c == "codigo_produto":
            steps[c] = F.coalesce(text.digits_or_null(F.col(c)), text.blank_to_null(text.squeeze(F.col(c))))
    return items.withColumns(steps)


def fuse(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """One row a key: of each field the value of the last source that has one; aliases and mirrors filled."""
    names = list(dict.fromkeys(c for s in sources for c in s.columns if c != key))
    rows = None
    for i, s in enumerate(sources):
        own = s.select(key, F.lit(i).alias("_from"), *[(F.col(c) if c in s.columns else F.lit(None)).cast("string").alias(c) for c in names])
        rows = own if rows is None else rows.unionByName(own)
    best = [F.max_by(c, F.when(~text.missing(F.col(c)), F.col("_from"))).alias(c) for c in names]
    return with_mirrors(with_aliases(rows.groupBy(key).agg(*best)))
