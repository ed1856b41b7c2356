"""Scalar functions over strings made from the driver tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fiscal, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _orders(spark: SparkSession, sf_dir: str, made: Column, **columns: Callable[[Column], Column]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", made.alias("s"))
    return rows.select("o_orderkey", *[f(F.col("s")).alias(n) for n, f in columns.items()])


def _add(name: str, made: str, sql_made: str, sql: str, **columns: Callable[[Column], Column]) -> None:
    """made and sql_made say the same string in the two dialects; sql computes the columns from s."""
    QUERIES[name] = (lambda spark, sf_dir: _orders(spark, sf_dir, F.expr(made), **columns), f"WITH t AS (SELECT o_orderkey, {sql_made} AS s FROM orders) SELECT o_orderkey, {sql} FROM t")


def _spark_array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


_K = "cast(o_orderkey as string)"
_V = "CAST(o_orderkey AS VARCHAR)"

_add(
    "number_br_parse",
    f"case o_orderkey % 5 when 0 then concat('R$ 1.', lpad({_K}, 3, '0'), ',50') when 1 then concat('1,', lpad({_K}, 3, '0'), '.25') when 2 then concat('-', {_K}, ',5') when 3 then 'abc' else concat({_K}, '.125') end",
    f"CASE o_orderkey % 5 WHEN 0 THEN 'R$ 1.' || lpad({_V}, 3, '0') || ',50' WHEN 1 THEN '1,' || lpad({_V}, 3, '0') || '.25' WHEN 2 THEN '-' || {_V} || ',5' WHEN 3 THEN 'abc' ELSE {_V} || '.125' END",
    "CASE o_orderkey % 5 WHEN 0 THEN CAST(replace(replace(replace(s, 'R$ ', ''), '.', ''), ',', '.') AS DOUBLE) WHEN 1 THEN CAST(replace(s, ',', '') AS DOUBLE) WHEN 2 THEN CAST(replace(s, ',', '.') AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(s AS DOUBLE) END AS v",
    v=text.number_br,
)
_add(
    "date_like_parse",
    "case o_orderkey % 4 when 0 then date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") when 1 then date_format(o_orderdate, 'dd/MM/yyyy') when 2 then concat('em ', date_format(o_orderdate, 'yyyy/MM/dd')) else 'x' end",
    "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN 'em ' || strftime(o_orderdate, '%Y/%m/%d') ELSE 'x' END",
    "CASE o_orderkey % 4 WHEN 0 THEN s[1:10] WHEN 1 THEN s[7:10] || '-' || s[4:5] || '-' || s[1:2] WHEN 2 THEN replace(s[4:13], '/', '-') ELSE NULL END AS d",
    d=text.iso_date,
)
_add(
    "mask_ids",
    f"case o_orderkey % 3 when 0 then lpad({_K}, 14, '1') when 1 then lpad({_K}, 11, '2') else {_K} end",
    f"CASE o_orderkey % 3 WHEN 0 THEN lpad({_V}, 14, '1') WHEN 1 THEN lpad({_V}, 11, '2') ELSE {_V} END",
    "CASE length(s) WHEN 14 THEN s[1:2] || '.' || s[3:5] || '.' || s[6:8] || '/' || s[9:12] || '-' || s[13:14] WHEN 11 THEN s[1:3] || '.' || s[4:6] || '.' || s[7:9] || '-' || s[10:11] ELSE s END AS m",
    m=text.mask_tax_id,
)
_add("digits", f"concat('A-', {_K}, '/00 x')", f"'A-' || {_V} || '/00 x'", "regexp_replace(s, '[^0-9]', '', 'g') AS d, coalesce(nullif(ltrim(regexp_replace(s, '[^0-9]', '', 'g'), '0'), ''), '0') AS n", d=text.digits, n=text.invoice_number)
_NAMES = ["São JOÃO  &  Cia. nº", "  ÁGUAS do Ribeirão--Sul", "D\\'Ávila e Irmãos (matriz)", "Açúcar+Café/3", "Über-Müller §", "niño; piñata: 100%", "PÃO...DE...QUEIJO", "¿Qué? ¡Sí!"]
_NAMED = f"concat(' ', element_at({_spark_array(_NAMES)}, cast(o_orderkey % {len(_NAMES)} + 1 as int)), ' ', {_K}, ' ')"
_NAMED_SQL = f"' ' || ({[n.replace(chr(92), '') for n in _NAMES]!r})[CAST(o_orderkey % {len(_NAMES)} + 1 AS INT)] || ' ' || {_V} || ' '".replace('"D\'Ávila e Irmãos (matriz)"', "'D''Ávila e Irmãos (matriz)'")
_add("tokens", _NAMED, _NAMED_SQL, "trim(regexp_replace(lower(strip_accents(s)), '[^a-z0-9]+', ' ', 'g')) AS t", t=text.word_tokens)
_add("squeezed", f"concat('  a \\t b\\n', {_K}, ' ')", f"'  a ' || chr(9) || ' b' || chr(10) || {_V} || ' '", "trim(regexp_replace(s, '\\s+', ' ', 'g')) AS t", t=text.squeeze)
_SUFFIXES = ["Ltda", "me", "s/a", "EPP", "eireli"]
_add(
    "company_suffix",
    f"concat('Casa ', {_K}, ' ', element_at({_spark_array(_SUFFIXES)}, cast(o_orderkey % 5 + 1 as int)), ' ', element_at({_spark_array(_SUFFIXES[::-1])}, cast(o_orderkey % 4 + 1 as int)))",
    f"'Casa ' || {_V} || ' ' || ({_SUFFIXES})[CAST(o_orderkey % 5 + 1 AS INT)] || ' ' || ({_SUFFIXES[::-1]})[CAST(o_orderkey % 4 + 1 AS INT)]",
    "'Casa ' || upper(substr(s, 6)) AS t",
    t=text.company_name,
)
#: Words of payments in text around them; every order has another.
_SAID = ["Pix", "QR Code", "instantâneo", "Crédito", "credito", "DÉBITO", "debito", "dinheiro", "cash", "Boleto", "cheque", "check", "Transferência", "TED", "doc", "à vista", "A VISTA", "imediato", "parcelado", "a prazo", "crediario", "vale", "x"]
_ASKED = f"concat('pago ', element_at({_spark_array(_SAID)}, cast(o_orderkey % {len(_SAID)} + 1 as int)), ' n ', {_K})"
_ASKED_SQL = f"'pago ' || ({_SAID})[CAST(o_orderkey % {len(_SAID)} + 1 AS INT)] || ' n ' || {_V}"
_add(
    "payment_class",
    _ASKED,
    _ASKED_SQL,
    "CASE WHEN regexp_matches(lower(s), 'pix|qr|instant[aâ]neo') THEN 'PIX' WHEN regexp_matches(lower(s), 'cr[eé]dito') THEN 'CARTAO_CREDITO' WHEN regexp_matches(lower(s), 'd[eé]bito') THEN 'CARTAO_DEBITO'"
    " WHEN regexp_matches(lower(s), 'dinheiro|cash') THEN 'DINHEIRO' WHEN lower(s) LIKE '%boleto%' THEN 'BOLETO' WHEN regexp_matches(lower(s), 'che(que|ck)') THEN 'CHEQUE'"
    " WHEN regexp_matches(lower(s), 'transfer|ted|doc') THEN 'TRANSFERENCIA' ELSE 'OUTRO' END AS p",
    p=fiscal.payment_means,
)
_add(
    "payment_terms",
    _ASKED,
    _ASKED_SQL,
    "CASE WHEN regexp_matches(lower(s), 'avista|[aà] vista|cash|imediat') THEN 'A_VISTA' WHEN regexp_matches(lower(s), 'parcel|a prazo|crediario') THEN 'PARCELADO' ELSE upper(s) END AS p",
    p=fiscal.payment_terms,
)
_add(
    "card_brand",
    f"case o_orderkey % 4 when 0 then concat(' American  ', {_K}) when 1 then concat('mastercard ', {_K}) when 2 then concat(' Visa  ', {_K}) else '' end",
    f"CASE o_orderkey % 4 WHEN 0 THEN ' American  ' || {_V} WHEN 1 THEN 'mastercard ' || {_V} WHEN 2 THEN ' Visa  ' || {_V} ELSE '' END",
    "CASE WHEN s = '' THEN '' WHEN contains(upper(s), 'AMERICAN') THEN 'AMERICAN EXPRESS' WHEN contains(upper(s), 'MASTER') THEN 'MASTERCARD' ELSE upper(trim(regexp_replace(s, ' +', ' ', 'g'))) END AS b",
    b=fiscal.card_brand,
)
_UNITS = [*fiscal.REGIONS, "XX", "ZZ", "QQ"]
_CITY = "concat('Vila ', translate({k}, '0123456789', 'abcdefghij'), element_at(array('/', ' - ', ', ', ' '), cast(o_orderkey % 4 + 1 as int)), element_at({units}, cast(o_orderkey % {n} + 1 as int)))"
_add(
    "city_region_split",
    _CITY.format(k=_K, units=_spark_array([u.lower() if i % 3 == 0 else u for i, u in enumerate(_UNITS)]), n=len(_UNITS)),
    f"'Vila ' || translate({_V}, '0123456789', 'abcdefghij') || (['/', ' - ', ', ', ' '])[CAST(o_orderkey % 4 + 1 AS INT)] || ({[u.lower() if i % 3 == 0 else u for i, u in enumerate(_UNITS)]})[CAST(o_orderkey % {len(_UNITS)} + 1 AS INT)]",
    f"CASE WHEN upper(right(s, 2)) IN ({str(list(fiscal.REGIONS))[1:-1]}) THEN regexp_replace(left(s, -2), '[ /,-]+$', '') END AS c, CASE WHEN upper(right(s, 2)) IN ({str(list(fiscal.REGIONS))[1:-1]}) THEN upper(right(s, 2)) END AS u",
    c=fiscal.city_of,
    u=fiscal.region_of,
)
_CODES = "map {" + ", ".join(f"'{code}': '{unit}'" for code, unit in fiscal.REGION_CODES.items()) + "}"
_add(
    "region_from_code",
    f"concat(lpad(cast(o_orderkey % 100 as string), 2, '0'), lpad({_K}, 42, '0'))",
    f"lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || lpad({_V}, 42, '0')",
    f"({_CODES})[s[1:2]] AS u, ({_CODES})[s[1:2]] AS c",
    u=fiscal.region_of_key,
    c=fiscal.region_of_city_code,
)


def _check_sql(weights: list[int], digits: str) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: CAST(substr({digits}, i, 1) AS INT) * ({weights})[i]))"


_FIRST = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
_add(
    "cnpj_valid",
    f"lpad({_K}, 14, '0')",
    f"lpad({_V}, 14, '0')",
    f"CASE WHEN regexp_full_match(s, '0+') THEN FALSE ELSE (CASE WHEN {_check_sql(_FIRST, 's')} % 11 < 2 THEN 0 ELSE 11 - {_check_sql(_FIRST, 's')} % 11 END) = CAST(s[13] AS INT) AND (CASE WHEN {_check_sql([6, *_FIRST], 's')} % 11 < 2 THEN 0 ELSE 11 - {_check_sql([6, *_FIRST], 's')} % 11 END) = CAST(s[14] AS INT) END AS ok",
    ok=fiscal.valid_cnpj,
)
_add(
    "cpf_valid",
    f"lpad({_K}, 11, '0')",
    f"lpad({_V}, 11, '0')",
    f"CASE WHEN regexp_full_match(s, '0+') THEN FALSE ELSE ({_check_sql(list(range(10, 1, -1)), 's')} * 10 % 11) % 10 = CAST(s[10] AS INT) AND ({_check_sql(list(range(11, 1, -1)), 's')} * 10 % 11) % 10 = CAST(s[11] AS INT) END AS ok",
    ok=fiscal.valid_cpf,
)
_add(
    "key_search",
    f"case o_orderkey % 4 when 0 then concat('https://x?chNFe=', lpad({_K}, 44, '7'), '&y=1') when 1 then concat('https://x?a=1&CHCTE=', lpad({_K}, 44, '3')) when 2 then concat('chave ', lpad({_K}, 44, '5'), ' ou ', lpad({_K}, 44, '6')) else concat('x', lpad({_K}, 45, '1'), ' 12') end",
    f"CASE o_orderkey % 4 WHEN 0 THEN 'https://x?chNFe=' || lpad({_V}, 44, '7') || '&y=1' WHEN 1 THEN 'https://x?a=1&CHCTE=' || lpad({_V}, 44, '3') WHEN 2 THEN 'chave ' || lpad({_V}, 44, '5') || ' ou ' || lpad({_V}, 44, '6') ELSE 'x' || lpad({_V}, 45, '1') || ' 12' END",
    "nullif(regexp_extract(s, '(^|[^0-9a-zA-Z])([0-9]{44})([^0-9a-zA-Z]|$)', 2), '') AS k",
    k=fiscal.key_in_text,
)
_add("address_compose", f"concat('Rua ', {_K})", f"'Rua ' || {_V}", "s || ', 10, Centro' AS a", a=lambda s: text.joined_address(s, F.lit("10"), F.lit("  "), F.lit("Centro")))
_add(
    "series_and_model",
    f"case o_orderkey % 3 when 0 then concat(' a ', {_K} % 1000) when 1 then 'longer-than-six' else '' end",
    f"CASE o_orderkey % 3 WHEN 0 THEN ' a ' || CAST(o_orderkey % 1000 AS VARCHAR) WHEN 1 THEN 'longer-than-six' ELSE '' END",
    "CASE o_orderkey % 3 WHEN 0 THEN 'A' || CAST(o_orderkey % 1000 AS VARCHAR) END AS a, CASE o_orderkey % 3 WHEN 0 THEN 'A' || CAST(o_orderkey % 1000 AS VARCHAR) END AS b",
    a=text.series,
    b=text.model,
)
_add(
    "layout_print",
    f"concat('Nota ', {_K}, ' |  Série: ', element_at({_spark_array(_NAMES)}, cast(o_orderkey % {len(_NAMES)} + 1 as int)))",
    f"'Nota ' || {_V} || ' |  Série: ' || " + _NAMED_SQL.split(" || ")[1],
    "sha256('cols||' || trim(regexp_replace(regexp_replace(lower(strip_accents(s)), '[^a-z0-9|:;,.% -]', ' ', 'g'), ' +', ' ', 'g')))[1:32] AS f",
    f=lambda s: text.layout_fingerprint(F.lit("cols"), s),
)
