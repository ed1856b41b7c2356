"""The rule engine: every check is a column, so one pass over documents and their sums judges all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal, text
from ..sources import rules as R
from . import aggregates

OPEN_STATUS = ("", "processando", "quarentena", "revisao_pendente")


def required_missing(df: DataFrame) -> Column:
    """Names of required fields without a value; service invoices need no key, a total of services stands for the total."""
    kind = F.lower(F.trim(F.coalesce("tipo", F.lit(""))))
    service = kind.isin("nfse", "nfs-e", "nf s-e")
    gone = lambda c: text.missing(F.col(c))
    issuer = gone("emitente_cnpj") & gone("emitente_cpf")
    tests = [("data_emissao", gone("data_emissao")), ("valor_total", gone("valor_total") & gone("total_servicos")), ("chave_acesso", ~service & gone("chave_acesso")), ("emitente_cnpj", issuer)]
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())


def confidence(ok: Column, total: Column) -> Column:
    """Share of checks passed, a little more if there were many and most passed; 0 without checks."""
    base = ok / total
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), base + F.when((total >= 12) & (base > 0.7), 0.05).otherwise(0.0)))


def close(a: Column, b: Column, base: Column, *, tolerance: float = R.TOLERANCE, share: float = R.TOLERANCE_SHARE) -> tuple[Column, Column]:
    """Whether two sums agree within the absolute and the relative tolerance; the relative one only counts with a positive base."""
    gap = F.abs(a - b)
    near = gap <= F.lit(tolerance).cast("decimal(18,4)")
    return near, F.coalesce(F.when(base > 0, gap.cast("double") / base.cast("double") <= share), F.lit(True))


def violates(rows: DataFrame, column: str, dimension: DataFrame, kinds: list[str], pattern: str, name: str) -> DataFrame:
    """rows with a flag of that name, true where code_violations would keep the row."""
    known = dimension.where(F.col("kind").isin(*kinds)).select(F.col("code").alias("_code")).distinct()
    code = F.trim(column)
    if not known.limit(1).count():
        return rows.withColumn(name, ~text.missing(code) & ~code.rlike(pattern))
    return rows.join(F.broadcast(known), code == F.col("_code"), "left").withColumn(name, ~text.missing(code) & F.col("_code").isNull()).drop("_code")


def code_violations(rows: DataFrame, column: str, dimension: DataFrame, kinds: list[str], pattern: str) -> DataFrame:
    """Rows whose code isn't in the dimension; with no codes of those kinds, whose code doesn't have the form.

    Blank codes pass. The dimension is a few fixed rows.
    """
    known = dimension.where(F.col("kind").isin(*kinds)).select(F.col("code").alias("_code")).distinct()
    code = F.trim(column)
    given = rows.where(~text.missing(code))
    if known.limit(1).count():
        return given.join(F.broadcast(known), code == F.col("_code"), "left_anti")
    return given.where(~code.rlike(pattern))


def class_findings(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """id, documento_id, ncm, erro, aviso: classes that aren't eight digits, and those that the catalogue lacks."""
    known = catalogue.select(F.col("codigo").alias("_code")).distinct()
    given = items.where(~text.missing(F.trim("ncm"))).withColumn("ncm", F.trim("ncm")).join(known, F.col("ncm") == F.col("_code"), "left")
    formed = F.col("ncm").rlike("^[0-9]{8}$")
    found = given.select("id", "documento_id", "ncm", F.when(~formed, "formato").alias("erro"), F.when(formed & F.col("_code").isNull(), "fora do catálogo").alias("aviso"))
    return found.where("erro is not null or aviso is not null")


def crossing(code: Column, issuer: Column, recipient: Column) -> Column:
    """True where an operation code says the opposite of what the two regions do."""
    a, b = F.upper(F.trim(issuer)), F.upper(F.trim(recipient))
    both = (F.length(code) == 4) & ~text.missing(a) & ~text.missing(b)
    return F.coalesce(both & (((F.left(code, F.lit(1)) == "6") & (a == b)) | ((F.left(code, F.lit(1)) == "5") & (a != b))), F.lit(False))


def _checks(strict_location: bool) -> list[tuple[str, Column, Column, bool, bool]]:
    """(code, applies, ok, structural, warning only) of each check that counts."""
    d = lambda c: F.coalesce(text.digits(F.col(c)), F.lit(""))
    either = lambda f: text.first_filled(F.trim(f"emitente_{f}"), F.trim(f"destinatario_{f}"))
    region = F.upper(either("uf"))
    key_region = fiscal.region_of_key(F.col("chave_acesso"))
    has = lambda c: d(c) != ""
    out = [
        ("emitente_cnpj", has("emitente_cnpj"), fiscal.valid_cnpj(F.col("emitente_cnpj")), False, False),
        ("destinatario_cnpj", F.length(d("destinatario_cnpj")) == 14, fiscal.valid_cnpj(F.col("destinatario_cnpj")), False, False),
        ("emitente_cpf", has("emitente_cpf"), fiscal.valid_cpf(F.col("emitente_cpf")), False, False),
        ("destinatario_cpf", has("destinatario_cpf"), fiscal.valid_cpf(F.col("destinatario_cpf")), False, False),
        ("uf", region.isNotNull(), region.isin(*fiscal.REGIONS), False, False),
        ("uf_ausente", region.isNull(), F.lit(False), strict_location, not strict_location),
        ("municipio", F.lit(True), either("municipio").isNotNull(), False, not strict_location),
        ("endereco", F.lit(True), either("endereco").isNotNull(), False, not strict_location),
        ("uf_chave", region.isNotNull() & key_region.isNotNull() & (region != key_region), F.lit(False), True, False),
    ]
    total = F.coalesce(F.col("valor_total").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    near, within = close(F.col("soma_itens"), total, total)
    out.append(("valor_total", F.col("n_itens") > 0, near & within, False, False))
    out.append(("valor_total_estrutural", F.lit(False), near | within, True, False))
    for kind in ("icms", "ipi", "pis", "cofins"):
        own = F.coalesce(F.col(f"total_{kind}").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
        near, within = close(F.col(f"soma_{kind}"), own, F.when(own > 0, own).when(total > 0, total))
        out.append((f"total_{kind}", F.col("n_impostos") > 0, near & within, False, False))
    return out


def validate(docs: DataFrame, items: DataFrame, taxes: DataFrame, dimension: DataFrame, catalogue: DataFrame | None = None, *, strict_location: bool = False, force: bool = False) -> DataFrame:
    """id, validacao, confianca, erros, avisos, faltando, reprocessar, motivos, novo_status, novo_motivo of every document.

    Documents in a settled status are left as they are, with confidence 1, unless force. Errors and warnings are codes.
    Item, class and tax codes are judged by joins with the rule dimension, and only their counts a document come back.
    """
    # Each child table is joined and summed once: what its rows break is a flag beside their values.
    money = lambda c: F.coalesce(F.col(c).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    code = F.trim("cfop")
    led = lambda digit: F.count_if((F.length(code) == 4) & (F.left(code, F.lit(1)) == digit))
    item_rows = violates(items.select("documento_id", "valor_total", "cfop"), "cfop", dimension, ["cfop"], r"^\d{4}$", "_bad")
    of_items = item_rows.groupBy("documento_id").agg(F.count("*").alias("n_itens"), F.sum(money("valor_total")).alias("soma_itens"), F.count_if("_bad").alias("n_cfop"), led("5").alias("_5"), led("6").alias("_6"))
    tax_rows = violates(taxes, "cst", dimension, ["cst_icms", "csosn_icms"], r"^\d{2,3}$", "_bad").withColumn("_bad", F.col("_bad") & (F.col("tipo_imposto") == "ICMS"))
    of_taxes = aggregates.tax_sums(tax_rows, items, n_cst=F.count_if("_bad"))
    wide = docs.withColumn("documento_id", F.col("id"))
    extra = [of_items, of_taxes]
    if catalogue is not None:
        found = class_findings(items, catalogue)
        extra += [found.groupBy("documento_id").agg(F.count("erro").alias("n_ncm"), F.count("aviso").alias("n_ncm_aviso"))]
    for part in extra:
        wide = wide.join(part, "documento_id", "left")
    if catalogue is None:
        wide = wide.withColumns({"n_ncm": F.lit(0), "n_ncm_aviso": F.lit(0)})
    # Only the first digit of a code meets the regions, so its lines are counted by it and held against them once a document.
    against = lambda digit: F.when(crossing(F.lit(f"{digit}000"), F.col("emitente_uf"), F.col("destinatario_uf")), F.col(f"_{digit}")).otherwise(0)
    wide = wide.withColumn("n_cfop_uf", against(5) + against(6))
    checks = _checks(strict_location)
    flags = {c: F.when(F.coalesce(applies, F.lit(False)), F.coalesce(ok, F.lit(False))) for c, applies, ok, _, _ in checks}
    # A column each: the fields of a struct would be put in place of their names, and judged again wherever they are asked for.
    wide = wide.withColumns({f"_c_{k}": v for k, v in flags.items()})
    wide = wide.withColumn("_s", F.when(F.col("n_itens") > 0, ~next(ok for c, _, ok, _, _ in checks if c == "valor_total_estrutural")))
    counts = lambda f: sum((F.when(f(F.col(f"_c_{c}")), 1).otherwise(0) for c in flags), F.lit(0))
    passed, total = counts(lambda c: F.coalesce(c, F.lit(False))), counts(lambda c: c.isNotNull())
    failed = lambda c: ~F.coalesce(F.col(f"_c_{c}"), F.lit(True))
    listed = lambda pairs: F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in pairs]), lambda x: x.isNotNull())
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    wide = wide.withColumn("faltando", required_missing(wide))
    lacks = F.size("faltando") > 0
    errors = [(c, failed(c)) for c, _, _, _, warn in checks if not warn] + [("cfop", some("n_cfop")), ("ncm", some("n_ncm")), ("cst_icms", some("n_cst")), ("cfop_uf", some("n_cfop_uf")), ("obrigatorios", lacks)]
    structural = lacks | some("n_cfop_uf") | F.coalesce(F.col("_s"), F.lit(False))
    for c, _, _, s, _ in checks:
        structural = structural | failed(c) if s else structural
    out = wide.select(
        "id", F.coalesce("status", F.lit("")).alias("_status"), "faltando", F.round(confidence(passed, total), 4).alias("confianca"), listed(errors).alias("erros"),
        F.concat(listed([(c, failed(c)) for c, _, _, _, warn in checks if warn]), listed([("ncm", some("n_ncm_aviso"))])).alias("avisos"), structural.alias("_structural"),
    )
    bad = F.size("erros") > 0
    out = out.withColumn("validacao", F.when(~bad, "valido").when(F.col("confianca") >= 0.6, "parcial").otherwise("invalido"))
    settled = F.lit(False) if force else ~F.col("_status").isin(*OPEN_STATUS)
    keep = lambda c, value: F.when(settled, value).otherwise(c)
    none = F.array().cast("array<string>")
    return out.select(
        "id", keep(F.col("validacao"), F.col("_status")).alias("validacao"), keep(F.col("confianca"), F.lit(1.0)).alias("confianca"), keep(F.col("erros"), none).alias("erros"), keep(F.col("avisos"), none).alias("avisos"), "faltando",
        keep(F.col("_structural") | ((F.col("validacao") != "valido") & (F.col("confianca") < 0.65)), F.lit(False)).alias("reprocessar"),
        keep(F.when(F.col("_structural"), F.array(F.lit("estrutural"))).otherwise(none), none).alias("motivos"),
        keep(F.when(bad, "revisao_pendente").when(F.col("_status").isin(*OPEN_STATUS), "processado").otherwise(F.col("_status")), F.col("_status")).alias("novo_status"),
        keep(F.when(bad, F.left(F.concat_ws("; ", "erros"), F.lit(255))), F.lit(None)).alias("novo_motivo"),
    )


# The fields that may be taken from elsewhere.
ENRICHABLE = ("emitente_cnpj", "destinatario_cnpj", "emitente_cpf", "destinatario_cpf", "valor_total", "data_emissao", "chave_acesso", "numero_nota", "serie", "modelo", "uf")


def enrich(docs: DataFrame, found: DataFrame, fields: tuple[str, ...] = ENRICHABLE) -> DataFrame:
    """docs with gaps in fields filled from found: an id, once each, and some of the fields.

    Ids of parties are reduced to their digits and totals to a number, 0 where none is written; a field that either side
    lacks is passed over.
    """
    kinds = dict(docs.dtypes)
    fields = [c for c in fields if c in kinds and c in found.columns]
    given = {c: F.col(c) for c in fields}
    clean = {c: text.digits(v) if c.endswith(("_cnpj", "_cpf")) else text.number_or_zero(v) if c == "valor_total" else v for c, v in given.items()}
    other = found.select("id", *[F.when(~text.missing(given[c].cast("string")), v).try_cast(kinds[c]).alias(f"_{c}") for c, v in clean.items()])
    gaps = {c: F.when(text.missing(F.col(c).cast("string")), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    return docs.join(other, "id", "left").withColumns(gaps).drop(*[f"_{c}" for c in fields])
