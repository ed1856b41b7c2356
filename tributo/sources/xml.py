"""Fiscal documents in XML: one Arrow-batched function walks the tree, everything after it is column expressions.

What each layout keeps where is a table of rules, not code: a field has alternatives, tried in order, each an anchor
element, a way of looking from it, and a tag. Names are compared without namespace and case.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal, text
from .shapes import Pick, Rows, Shapes

Rule = tuple[str, str, str]  # anchor, look ("child", "deep" or "attr"), tag


#: Names by the tags that they were made of; emptied when full, as documents may bring any tags.
_NAMES: dict[str, str] = {}
_NAMES_KEPT = 10_000


def _name(e: ET.Element) -> str:
    if (got := _NAMES.get(e.tag)) is None:
        if not isinstance(e.tag, str):
            return ""
        if len(_NAMES) >= _NAMES_KEPT:
            _NAMES.clear()
        got = _NAMES[e.tag] = e.tag.rsplit("}", 1)[-1].lower()
    return got


def _clean(s: str | None) -> str | None:
    s = (s or "").strip()
    return s or None


class Tree:
    """Lookups in one document. Tags are written in lower case, those of attributes as they are.

    What lies below an element is listed by name when it is first asked for, so a lookup passes over no other elements.
    """

    def __init__(self, root: ET.Element):
        self.root = root
        self._below: dict[ET.Element, dict[str, list[ET.Element]]] = {}
        self._children: dict[ET.Element, dict[str, str | None]] = {}

    def below(self, base: ET.Element) -> dict[str, list[ET.Element]]:
        """base and its descendants in order, by name."""
        got = self._below.get(base)
        if got is None:
            got = self._below[base] = {}
            for e in base.iter():
                name = _NAMES.get(e.tag) or _name(e)
                if name in got:
                    got[name].append(e)
                else:
                    got[name] = [e]
        return got

    def find(self, base: ET.Element | None, path: str) -> ET.Element | None:
        """First match of a/b/c: a anywhere below base or base itself, the others children of the one before."""
        if base is None:
            return None
        if "/" in path:
            return next(self.every(base, path), None)
        matches = self.below(base).get(path)
        return matches[0] if matches else None

    def every(self, base: ET.Element | None, path: str) -> Iterator[ET.Element]:
        if base is None:
            return
        first, _, rest = path.partition("/")
        matches = self.below(base).get(first, ())
        if not rest:
            yield from matches
            return
        names = rest.split("/")
        for e in matches:
            for c in e:
                yield from self._chain(c, names)

    def _chain(self, e: ET.Element, names: list[str]) -> Iterator[ET.Element]:
        if _name(e) == names[0]:
            if len(names) == 1:
                yield e
            else:
                for c in e:
                    yield from self._chain(c, names[1:])

    def children(self, base: ET.Element) -> dict[str, str | None]:
        """Text of the first child of each name."""
        got = self._children.get(base)
        if got is None:
            got = self._children[base] = {}
            for c in base:
                name = _NAMES.get(c.tag) or _name(c)
                if name not in got:
                    got[name] = text.strip() or None if (text := c.text) else None
        return got

    def child(self, base: ET.Element | None, tag: str) -> str | None:
        """Text of the first child of that name; nothing further is tried if it is empty."""
        return None if base is None else self.children(base).get(tag)

    def deep(self, base: ET.Element | None, tag: str) -> str | None:
        """Text of the first descendant of that name that has any."""
        if base is None:
            return None
        for e in self.below(base).get(tag, ()):
            if t := _clean(e.text):
                return t
        return None

    def attr(self, base: ET.Element | None, tag: str) -> str | None:
        return None if base is None else _clean(base.get(tag))


#: kind -> anchor -> alternatives (path, from anchor, whether an element without children counts as missing)
_ADDRESS = ("xLgr", "nro", "xCpl", "xBairro", "xMun", "UF", "CEP")
_ADDRESS_FIELDS = ("logradouro", "numero", "complemento", "bairro", "municipio", "uf", "cep")


def _party(prefix: str, anchor: str, address: tuple[str, ...], tags: dict[str, str]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {f"{prefix}_{f}": [(anchor, "child", t)] for f, t in tags.items()}
    for f, t in zip(_ADDRESS_FIELDS, _ADDRESS, strict=True):
        out[f"{prefix}_{f}"] = [(a, "child", t) for a in address]
    return out


_IDS = {"nome": "xNome", "cnpj": "CNPJ", "cpf": "CPF", "ie": "IE", "im": "IM"}
_DATES: list[Rule] = [("ide", "child", "dhEmi"), ("ide", "child", "dEmi")]
_LATE_DATES: list[Rule] = [("ide", "child", "dhEmi"), ("ide", "child", "dEmi"), ("ide", "child", "dIniViagem"), ("root", "deep", "DataEmissao"), ("root", "deep", "dataEmissao"), ("root", "deep", "Competencia")]

Anchor = tuple[str, str, bool]
LAYOUTS: dict[str, tuple[dict[str, list[Anchor]], dict[str, list[Rule]]]] = {
    "nfe": (
        {
            "ide": [("root", "ide", False)], "emit": [("root", "emit", False)], "dest": [("root", "dest", False)],
            "tot": [("root", "total/ICMSTot", False)], "ender_emit": [("root", "emit/enderEmit", False)], "ender_dest": [("root", "dest/enderDest", False)],
            "inf": [("root", "infNFe", False)], "pag": [("root", "pag/detPag", False), ("root", "pag", False)], "prod": [("root", "det/prod", False)],
            "transp": [("root", "transp", False)], "veic": [("transp", "veicTransp", True), ("transp", "veic", False)], "vol": [("transp", "vol", False)],
        },
        {"numero_nota": [("ide", "child", "nNF")], "serie": [("ide", "child", "serie")], "modelo": [("ide", "child", "mod")], "natureza_operacao": [("ide", "child", "natOp")]}
        | _party("emitente", "emit", ("ender_emit",), _IDS)
        | _party("destinatario", "dest", ("ender_dest",), _IDS)
        | {"data_emissao": _DATES}
        | {f: [("tot", "child", t)] for f, t in {"valor_total": "vNF", "total_produtos": "vProd", "total_servicos": "vServ", "valor_descontos": "vDesc", "valor_frete": "vFrete", "valor_seguro": "vSeg", "valor_outros": "vOutro", "total_icms": "vICMS", "total_ipi": "vIPI", "total_pis": "vPIS", "total_cofins": "vCOFINS"}.items()}
        | {"forma_pagamento": [("pag", "child", "tPag"), ("pag", "child", "indPag")], "valor_pagamento": [("pag", "child", "vPag")], "troco": [("root", "deep", "vTroco")]}
        | {"modalidade_frete": [("transp", "child", "modFrete")], "placa_veiculo": [("veic", "child", "placa")], "uf_veiculo": [("veic", "child", "UF")], "qtd_volumes": [("vol", "child", "qVol")], "peso_bruto": [("vol", "child", "pesoB")], "peso_liquido": [("vol", "child", "pesoL")]}
        | {"chave_acesso": [("inf", "attr", "Id")], "x:det/0/CFOP": [("prod", "child", "CFOP")]},
    ),
    "cte": (
        {
            "ide": [("root", "ide", False)], "emit": [("root", "emit", False)], "rem": [("root", "rem", False)], "dest": [("root", "dest", True), ("root", "rem", False)],
            "vprest": [("root", "vPrest", False)], "ender_emit": [("emit", "enderEmit", False)], "ender_dest": [("dest", "enderDest", False)], "ender_rem": [("rem", "enderReme", False)],
            "rodo": [("root", "rodo", False)], "veic": [("rodo", "veic", False)], "inf": [("root", "infCTe", False)],
        },
        {"numero_nota": [("ide", "child", "nCT")], "serie": [("ide", "child", "serie")], "modelo": [("ide", "child", "mod")]}
        | _party("emitente", "emit", ("ender_emit",), {k: _IDS[k] for k in ("nome", "cnpj", "ie")})
        | _party("destinatario", "dest", ("ender_dest", "ender_rem"), {k: _IDS[k] for k in ("nome", "cnpj", "ie")})
        | {"data_emissao": _DATES, "valor_total": [("vprest", "child", "vTPrest")], "placa_veiculo": [("veic", "child", "placa")], "uf_veiculo": [("veic", "child", "UF")], "chave_acesso": [("inf", "attr", "Id")], "x:cte/infCarga/vCarga": [("root", "deep", "vCarga")]},
    ),
    "mdfe": (
        {"ide": [("root", "ide", False)], "emit": [("root", "emit", False)], "tot": [("root", "tot", False)], "ender_emit": [("emit", "enderEmit", False)], "veic": [("root", "infModal/rodo/veicTracao", False)]},
        {"numero_nota": [("ide", "child", "nMDF")], "serie": [("ide", "child", "serie")], "modelo": [("ide", "child", "mod")]}
        | {k: v for k, v in _party("emitente", "emit", ("ender_emit",), {k: _IDS[k] for k in ("nome", "cnpj", "ie")}).items() if k != "emitente_cep"}
        | {"data_emissao": [*_DATES, ("ide", "child", "dIniViagem")], "valor_total": [("tot", "child", "vCarga")], "placa_veiculo": [("veic", "child", "placa")], "uf_veiculo": [("veic", "child", "UF")], "x:mdfe/tot/qCTe": [("root", "deep", "qCTe")]},
    ),
    "cfe": (
        {n: [("root", n, True), ("root", n, False)] for n in ("ide", "emit", "dest", "total", "pgto")}
        | {"ender_emit": [("emit", "enderEmit", False)], "ender_dest": [("dest", "enderDest", False)]},
        {"numero_nota": [("ide", "child", "nCFe"), ("ide", "child", "nNF")], "serie": [("ide", "child", "serie")], "modelo": [("ide", "child", "mod")]}
        | {
            k: v + [(v[0][0], "deep", alias) for tag, alias in (("xLgr", "Logradouro"), ("nro", "Numero"), ("xCpl", "Complemento"), ("xBairro", "Bairro"), ("CEP", "CEP")) if v[0][2] == tag]
            for k, v in (_party("emitente", "emit", ("ender_emit",), {k: _IDS[k] for k in ("nome", "cnpj", "ie")}) | _party("destinatario", "dest", ("ender_dest",), {k: _IDS[k] for k in ("nome", "cnpj", "ie")})).items()
        }
        | {"data_emissao": _DATES, "valor_total": [("total", "child", "vCFe"), ("total", "child", "vCFeLei12741"), ("total", "child", "vNF")], "troco": [("pgto", "deep", "vTroco")]},
    ),
    "nfse": (
        {
            "prest": [("root", "PrestadorServico", True), ("root", "Prestador", True), ("root", "prest", False)],
            "toma": [("root", "TomadorServico", True), ("root", "Tomador", True), ("root", "toma", False)],
            "emit": [("root", "emit", True), ("prest", "*", False)],
            "ender_emit": [("emit", "enderNac", True), ("emit", "Endereco", False)],
            "ender_toma": [("toma", "end", True), ("toma", "Endereco", True), ("toma", "endNac", False)],
        },
        {
            "emitente_nome": [("emit", "deep", "xNome"), ("prest", "deep", "RazaoSocial"), ("prest", "deep", "NomeFantasia"), ("prest", "deep", "xNome")],
            "emitente_cnpj": [("emit", "deep", "CNPJ"), ("prest", "deep", "Cnpj")], "emitente_cpf": [("emit", "deep", "CPF"), ("prest", "deep", "Cpf")],
            "destinatario_nome": [("toma", "deep", "RazaoSocial"), ("toma", "deep", "xNome"), ("toma", "deep", "Nome")],
            "destinatario_cnpj": [("toma", "deep", "Cnpj")], "destinatario_cpf": [("toma", "deep", "Cpf")],
            "valor_total": [("root", "deep", "vLiq"), ("root", "deep", "ValorServicos"), ("root", "deep", "vServ"), ("root", "deep", "ValorLiquidoNfse")],
            "total_servicos": [("root", "deep", "vLiq"), ("root", "deep", "ValorServicos"), ("root", "deep", "vServ"), ("root", "deep", "ValorLiquidoNfse")],
            "data_emissao": [("root", "deep", "dhEmi"), ("root", "deep", "DataEmissao"), ("root", "deep", "dtEmissao"), ("root", "deep", "Competencia")],
            "x:servico/Codigo": [("root", "deep", "ItemListaServico"), ("root", "deep", "CodigoServico"), ("root", "deep", "cTribNac")],
            "x:iss/Aliquota": [("root", "deep", "Aliquota"), ("root", "deep", "pISS")],
            "m:emitente": [("ender_emit", "deep", "cMun"), ("emit", "deep", "cMun"), ("prest", "deep", "CodigoMunicipioPrestador"), ("root", "deep", "CodigoMunicipio")],
            "m:destinatario": [("ender_toma", "deep", "cMun"), ("toma", "deep", "CodigoMunicipioTomador"), ("toma", "deep", "CodigoMunicipio")],
        }
        | {
            f"{p}_{f}": [(a, "deep", t) for t in tags]
            for p, a in (("emitente", "ender_emit"), ("destinatario", "ender_toma"))
            for f, tags in {"logradouro": ("Endereco", "xLgr", "Logradouro"), "numero": ("Numero", "nro"), "complemento": ("Complemento", "xCpl"), "bairro": ("Bairro", "xBairro"), "cep": ("CEP",), "uf": ("UF", "Estado"), "municipio": ("xMun", "Municipio")}.items()
        },
    ),
    "generic": (
        {n: [("root", n, True), ("root", n, False)] for n in ("ide", "emit", "total")} | {"ender_emit": [("root", "enderEmit", True), ("root", "enderEmit", False)]},
        {
            "numero_nota": [("ide", "child", "nNF"), ("ide", "child", "nCT"), ("ide", "child", "nCFe")], "serie": [("ide", "child", "serie")], "modelo": [("ide", "child", "mod")],
            "emitente_uf": [("ender_emit", "child", "UF")], "emitente_municipio": [("ender_emit", "child", "xMun")], "data_emissao": _DATES,
            "valor_total": [("total", "child", "vNF"), ("total", "child", "vCFe"), ("total", "child", "vTPrest")],
        }
        | {f"emitente_{k}": [("emit", "child", _IDS[k])] for k in ("nome", "cnpj", "cpf", "ie")}
        | {f"a:{t}": [("ender_emit", "child", t)] for t in _ADDRESS},
    ),
}

def _lowered(rules: list[Rule]) -> list[Rule]:
    return [(anchor, look, tag if look == "attr" else tag.lower()) for anchor, look, tag in rules]


LAYOUTS = {
    layout: ({n: [(base, path.lower(), needs) for base, path, needs in options] for n, options in anchors.items()}, {f: _lowered(r) for f, r in rules.items()})
    for layout, (anchors, rules) in LAYOUTS.items()
}
_LATE_DATES = _lowered(_LATE_DATES)

# Model codes and layouts.
KINDS = {"55": "NFe", "65": "NFCe", "57": "CTe", "67": "CTeOS", "58": "MDF-e", "59": "CF-e"}
LAYOUT_OF = {"NFe": "nfe", "NFCe": "nfe", "CTe": "cte", "CTeOS": "cte", "MDF-e": "mdfe", "CF-e": "cfe", "NFSe": "nfse"}
#: Kinds whose layout names its own key, so a referenced key never stands in.
OWN_KEY = ("NFe", "NFCe", "CTe", "CTeOS")
#: Where a total is looked for when the layout's own place has none: tags of the kind first, then these.
KIND_TOTALS = {"NFe": ("vnf",), "NFCe": ("vnf",), "CTe": ("vtprest",), "CTeOS": ("vtprest",), "CF-e": ("vcfe", "vcfelei12741", "vnf"), "NFSe": ("valorservicos", "vserv", "valorliquidonfse")}
TOTALS = ("vnf", "vcfe", "vtprest", "valorservicos")


def kind_of(t: Tree) -> str:
    """By the model code in the head, else by what the element names say."""
    ide = t.find(t.root, "ide")
    if ide is not None and (found := KINDS.get(t.deep(ide, "mod") or "")):
        return found
    if any("nfse" in n or "servico" in n or "serviço" in n for n in t.below(t.root)):
        return "NFSe"
    top = _name(t.root)
    for part, kind in (("nfe", "NFe"), ("cte", "CTe"), ("mdfe", "MDF-e"), ("cfe", "CF-e"), ("sat", "CF-e")):
        if part in top:
            return kind
    return "xml/desconhecido"


def _anchors(t: Tree, spec: dict[str, list[Anchor]]) -> dict[str, ET.Element | None]:
    got: dict[str, ET.Element | None] = {"root": t.root}
    for name, options in spec.items():
        got[name] = None
        for base, path, needs_children in options:
            e = got.get(base) if path == "*" else t.find(got.get(base), path)
            if e is not None and (len(e) or not needs_children):
                got[name] = e
                break
    return got


def _looked(t: Tree, got: dict[str, ET.Element | None], rules: list[Rule]) -> str | None:
    for anchor, look, tag in rules:
        if (base := got.get(anchor)) is not None and (v := t.children(base).get(tag) if look == "child" else getattr(t, look)(base, tag)):
            return v
    return None


def _authorisation(t: Tree) -> dict[str, str | None]:
    tech = next((e for e in (t.find(t.root, "infresptec"), t.find(t.root, "resptec")) if e is not None), None)
    return {
        "versao_schema": t.attr(t.root, "versao"), "ambiente": t.deep(t.root, "tpamb"), "protocolo_autorizacao": t.deep(t.root, "nprot"),
        "data_autorizacao": t.deep(t.root, "dhrecbto"), "cstat": t.deep(t.root, "cstat"), "xmotivo": t.deep(t.root, "xmotivo"),
        "responsavel_tecnico": next((v for tag in ("xcontato", "cnpj", "email") if (v := t.deep(tech, tag))), None),
    }


def _tax_rows(t: Tree, det: ET.Element) -> list[dict[str, str | None]]:
    def first(node: ET.Element, *tags: str) -> str | None:
        written = t.children(node)
        for tag in tags:
            if v := written.get(tag):
                return v
        return None

    out = []
    for outer in ("icms", "icmsufdest"):
        icms = t.find(det, outer)
        if icms is None or not len(icms):
            continue
        node = icms[0] if outer == "icms" else icms
        if value := first(node, "vicms", "vicmsst", "vicmsstret", "vicmsufdest", "vicmspartdest", "vicmspartremet"):
            out.append(
                {
                    "tipo_imposto": "ICMS", "cst": first(node, "cst", "csosn"), "origem": first(node, "orig"), "valor": value,
                    "base_calculo": first(node, "vbc", "vbcst", "vbcstret", "vbcufdest"),
                    "aliquota": first(node, "picms", "picmsst", "picmsstret", "picmsufdest", "picmsinter", "picmsinterpart"),
                }
            )
        if fcp := first(node, "vfcp"):
            out.append({"tipo_imposto": "FCP", "cst": None, "origem": None, "base_calculo": None, "aliquota": first(node, "pfcp"), "valor": fcp})
        break
    for kind, path, rate, value in (("IPI", "ipi/ipitrib", "pipi", "vipi"), ("PIS", "pis/pisaliq", "ppis", "vpis"), ("COFINS", "cofins/cofinsaliq", "pcofins", "vcofins")):
        node = t.find(det, path)
        if node is not None and (v := first(node, value)):
            out.append({"tipo_imposto": kind, "cst": first(node, "cst"), "origem": None, "base_calculo": first(node, "vbc"), "aliquota": first(node, rate), "valor": v})
    return out


# Tags of an item.
_ITEM = {"descricao": "xprod", "ean": "cean", "ncm": "ncm", "cest": "cest", "cfop": "cfop", "quantidade": "qcom", "unidade": "ucom", "valor_unitario": "vuncom", "valor_total": "vprod", "desconto": "vdesc", "outras_despesas": "voutro", "codigo_produto": "cprod"}


def read_document(content: bytes, *, items: bool = True) -> dict:
    """kind, error, fields (text as written), extras, items with taxes, and payments of one document.

    Bytes that don't parse are tried again as Latin-1. Documents that declare entities are refused. Without items they are
    left empty, for who wants the rest alone.
    """
    blank = {"kind": "xml/invalido", "error": None, "fields": {}, "extras": {}, "items": [], "payments": []}
    if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
        return blank | {"error": "declarations are not accepted"}
    try:
        root = ET.fromstring(content)
    except (ET.ParseError, ValueError, LookupError) as first:
        try:
            root = ET.fromstring(content.decode("latin-1").encode("utf-8"))
        except (ET.ParseError, ValueError, LookupError):
            return blank | {"error": str(first)}
    t = Tree(root)
    kind = kind_of(t)
    anchors, rules = LAYOUTS[LAYOUT_OF.get(kind, "generic")]
    got = _anchors(t, anchors)
    fields = {f: _looked(t, got, r) for f, r in rules.items()}
    extras = {f[2:]: v for f, v in fields.items() if f.startswith("x:") and v}
    address = {f[2:]: fields.pop(f) for f in list(fields) if f.startswith("a:")}
    if address:
        fields["emitente_endereco"] = ", ".join(v for v in address.values() if v) or None
    fields["emitente_cmun"], fields["destinatario_cmun"] = fields.pop("m:emitente", None), fields.pop("m:destinatario", None)
    fields = {f: v for f, v in fields.items() if not f.startswith("x:")}
    if not fields.get("data_emissao"):
        fields["data_emissao"] = _looked(t, {"root": root, "ide": t.find(root, "ide")}, _LATE_DATES)
    if not fields.get("valor_total"):
        fields["valor_total"] = next((v for tag in (*KIND_TOTALS.get(kind, ()), *TOTALS) if (v := t.deep(root, tag))), None)
    if kind not in OWN_KEY:
        fields["chave_acesso"] = next((v for v in (t.attr(t.find(root, "infnfe"), "Id"), t.attr(t.find(root, "infcte"), "Id"), t.deep(root, "chnfe"), t.deep(root, "chcte"), t.deep(root, "infcfe")) if v), None)
    payments = []
    if LAYOUT_OF.get(kind) == "cfe":
        payments = [{"code": t.child(mp, "cmp"), "value": t.child(mp, "vmp")} for mp in t.every(got.get("pgto"), "mp")]
    if LAYOUT_OF.get(kind) == "cte":
        for q in t.every(root, "infq"):
            if t.child(q, "cunid") == "03" and t.child(q, "qcarga"):
                fields["qtd_volumes"] = t.child(q, "qcarga")
                break
    read = []
    if items and kind not in ("CTe", "CTeOS", "MDF-e", "NFSe"):
        for det in t.every(root, "det"):
            prod = t.find(det, "prod")
            if prod is not None:
                written = t.children(prod)
                read.append({"numero_item": t.attr(det, "nItem"), "taxes": _tax_rows(t, det)} | {f: written.get(tag) for f, tag in _ITEM.items()})
    return {"kind": kind, "error": None, "fields": fields | _authorisation(t), "extras": extras, "items": read, "payments": payments}


_TAX = pa.struct([(c, pa.string()) for c in ("tipo_imposto", "cst", "origem", "base_calculo", "aliquota", "valor")])
_ITEM_TYPE = pa.struct([("numero_item", pa.string()), *[(c, pa.string()) for c in _ITEM], ("taxes", pa.list_(_TAX))])
_PAYMENT = pa.struct([("code", pa.string()), ("value", pa.string())])
_DOC_TYPE = {
    "kind": pa.string(),
    "error": pa.string(),
    "fields": pa.map_(pa.string(), pa.string()),
    "extras": pa.map_(pa.string(), pa.string()),
    "items": pa.list_(_ITEM_TYPE),
    "payments": pa.list_(_PAYMENT),
    "tempo": pa.float64(),
}
_ITEM_DDL = "struct<numero_item:string," + ",".join(f"{c}:string" for c in _ITEM) + ",taxes:array<struct<tipo_imposto:string,cst:string,origem:string,base_calculo:string,aliquota:string,valor:string>>>"
DOC_DDL = f"kind string, error string, fields map<string,string>, extras map<string,string>, items array<{_ITEM_DDL}>, payments array<struct<code:string,value:string>>, tempo double"


# Elements whose texts decide what is looked up.
_DECIDING = ("mod", "cunid")

#: Shapes of documents read with and without items; a Python worker keeps them from task to task.
_SHAPES = {items: Shapes(partial(read_document, items=items), lambda e: _name(e) in _DECIDING) for items in (False, True)}


class _Lists:
    """A column of lists of structs, filled flat: an Arrow array of nested rows, taken one by one, takes longer than reading them."""

    def __init__(self, kind: pa.StructType, **nested: _Lists):
        self.kind, self.nested, self.offsets, self.n = kind, nested, [0], 0
        self.columns: dict[str, list] = {f.name: [] for f in kind if f.name not in nested}

    def add(self, rows: list[dict]) -> None:
        for row in rows:
            for c, values in self.columns.items():
                values.append(row[c])
            for c, below in self.nested.items():
                below.add(row[c])
        self.n += len(rows)
        self.offsets.append(self.n)

    def pick(self, rows: Rows, values: list) -> None:
        """As add, of rows whose values stand in these places."""
        for c, picked in rows.columns.items():
            self.columns[c].extend(picked(values))
        for c, below in rows.nested.items():
            self.nested[c].pick(below, values)
        self.offsets.extend([self.n + end for end in rows.ends])
        self.n += rows.n

    def array(self) -> pa.Array:
        columns = [self.nested[f.name].array() if f.name in self.nested else pa.array(self.columns[f.name], f.type) for f in self.kind]
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(self.kind)), type=pa.list_(self.kind))


class _Maps:
    """A column of names and values, of what has a value."""

    def __init__(self):
        self.names, self.values, self.offsets = [], [], [0]

    def add(self, row: dict[str, str | None]) -> None:
        for name, value in row.items():
            if value is not None:
                self.names.append(name)
                self.values.append(value)
        self.offsets.append(len(self.names))

    def pick(self, held: tuple[list[str], Pick], values: list) -> None:
        """As add, of names whose values stand in these places."""
        names, picked = held
        self.names.extend(names)
        self.values.extend(picked(values))
        self.offsets.append(len(self.names))

    def array(self) -> pa.Array:
        return pa.MapArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))


def found(contents: Iterable[bytes | None], *, items: bool = True) -> dict[str, pa.Array]:
    """The columns of DOC_DDL, a row a content."""
    plain: dict[str, list] = {c: [] for c in ("kind", "error", "tempo")}
    nested = {"fields": _Maps(), "extras": _Maps(), "items": _Lists(_ITEM_TYPE, taxes=_Lists(_TAX)), "payments": _Lists(_PAYMENT)}
    for content in contents:
        start = time.perf_counter()
        content = content or b""
        if quick := _SHAPES[items].find(content):
            places, values = quick
            for c, held in places.maps.items():
                nested[c].pick(held, values)
            for c, rows in places.lists.items():
                nested[c].pick(rows, values)
            plain["kind"].append(places.kind)
            plain["error"].append(None)
        else:
            doc = read_document(content, items=items)
            for c in ("kind", "error"):
                plain[c].append(doc[c])
            for c, column in nested.items():
                column.add(doc[c])
        plain["tempo"].append(time.perf_counter() - start)
    return {c: nested[c].array() if c in nested else pa.array(plain[c], kind) for c, kind in _DOC_TYPE.items()}


def parse(files: DataFrame, *, items: bool = True) -> DataFrame:
    """files (nome_arquivo, content binary, and more) with what read_document finds in each, and tempo, its seconds.

    Other columns pass through. Spark can't leave out what a function makes, so who reads no items says so.
    """
    others = [f for f in files.schema.fields if f.name != "content"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = (b.as_py() for b in batch.column("content"))
            yield pa.record_batch({f.name: batch.column(f.name) for f in others} | found(contents, items=items))

    return files.mapInArrow(run, f"{ddl}, {DOC_DDL}")


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


_MONEY = ("valor_total", "total_produtos", "total_servicos", "valor_descontos", "valor_frete", "valor_seguro", "valor_outros", "valor_liquido", "total_icms", "total_ipi", "total_pis", "total_cofins", "valor_pagamento", "troco")

# Fields that completeness counts; coverage counts the key besides.
CORE_FIELDS = (
    "emitente_cnpj", "emitente_nome", "emitente_uf", "emitente_municipio", "destinatario_cnpj", "destinatario_nome", "destinatario_uf", "destinatario_municipio",
    "valor_total", "data_emissao", "numero_nota", "serie", "modelo", "total_produtos", "total_servicos", "total_icms", "total_pis", "total_cofins", "total_ipi",
)


def documents(parsed: DataFrame) -> DataFrame:
    """Typed document columns of parsed files; invalid ones go to quarantine with confidence 0."""
    party = lambda p: {
        f"{p}_nome": text.blank_to_null(text.squeeze(_field(f"{p}_nome"))), f"{p}_cnpj": text.digits_or_null(_field(f"{p}_cnpj")), f"{p}_cpf": text.digits_or_null(_field(f"{p}_cpf")),
        f"{p}_ie": _field(f"{p}_ie"), f"{p}_im": _field(f"{p}_im"), f"{p}_municipio": _field(f"{p}_municipio"),
        f"{p}_uf": F.coalesce(_field(f"{p}_uf"), fiscal.region_of_city_code(_field(f"{p}_cmun"))),
        f"{p}_endereco": F.coalesce(_field(f"{p}_endereco"), text.joined_address(*[_field(f"{p}_{f}") for f in _ADDRESS_FIELDS])),
    } | {f"{p}_{f}": _field(f"{p}_{f}") for f in ("logradouro", "numero", "complemento", "bairro", "cep")}
    paid = F.aggregate(F.filter(F.transform("payments", lambda p: text.strict_decimal(p["value"], 2)), lambda v: v.isNotNull()), F.lit(0).cast("decimal(18,2)"), lambda a, v: (a + v).cast("decimal(18,2)"), lambda a: F.when(a > 0, a))
    codes = F.filter(F.transform("payments", lambda p: p["code"]), lambda c: c.isNotNull())
    columns = party("emitente") | party("destinatario")
    columns |= {c: _field(c) for c in ("numero_nota", "serie", "modelo", "natureza_operacao", "modalidade_frete", "placa_veiculo", "uf_veiculo", "versao_schema", "ambiente", "protocolo_autorizacao", "cstat", "xmotivo", "responsavel_tecnico")}
    columns |= {c: text.strict_decimal(_field(c), 2) for c in _MONEY} | {c: text.strict_decimal(_field(c), 3) for c in ("peso_bruto", "peso_liquido")}
    columns |= {
        "qtd_volumes": text.strict_decimal(_field("qtd_volumes"), 0).cast("decimal(18,3)"),
        "forma_pagamento": F.coalesce(_field("forma_pagamento"), F.try_element_at(codes, F.lit(1))),
        "valor_pagamento": F.coalesce(text.strict_decimal(_field("valor_pagamento"), 2), paid),
        "data_emissao": text.iso_date(_field("data_emissao")), "data_autorizacao": text.iso_date(_field("data_autorizacao")),
        "chave_acesso": text.digits_or_null(_field("chave_acesso")),
    }
    typed = parsed.select(*[c for c in parsed.columns if c not in _DOC_TYPE or c in ("kind", "error", "extras", "tempo")], *[v.alias(k) for k, v in columns.items()])
    share = lambda names: F.round(sum((text.filled(F.col(c).cast("string")).cast("int") for c in names), F.lit(0)) / len(names), 3)
    return typed.withColumns(
        {
            "tipo": F.col("kind"), "status": F.when(F.col("error").isNull(), "processando").otherwise("quarentena"), "motivo_rejeicao": F.when(F.col("error").isNotNull(), F.concat(F.lit("XML inválido: "), "error")),
            "completude": F.when(F.col("error").isNull(), share(CORE_FIELDS)).otherwise(0.0), "cobertura": F.when(F.col("error").isNull(), share((*CORE_FIELDS, "chave_acesso"))).otherwise(0.0),
        }
    ).drop("kind")


def items(parsed: DataFrame, key: str) -> DataFrame:
    """One row an item: the document's key, its place, typed columns and its taxes as written."""
    each = parsed.select(F.col(key), F.posexplode("items").alias("ordem", "i"))
    return each.select(
        F.col(key), "ordem", text.positive_int(F.col("i.numero_item")).alias("numero_item"),
        *[F.col(f"i.{c}").alias(c) for c in ("descricao", "ean", "ncm", "cest", "cfop", "unidade", "codigo_produto")],
        text.strict_decimal(F.col("i.quantidade"), 3).alias("quantidade"), text.strict_decimal(F.col("i.valor_unitario"), 4).alias("valor_unitario"),
        *[text.strict_decimal(F.col(f"i.{c}"), 2).alias(c) for c in ("valor_total", "desconto", "outras_despesas")], F.col("i.taxes").alias("taxes"),
    )


def taxes(item_rows: DataFrame, key: str) -> DataFrame:
    each = item_rows.select(key, "ordem", F.explode("taxes").alias("t"))
    return each.select(key, "ordem", "t.tipo_imposto", "t.cst", "t.origem", text.strict_decimal(F.col("t.base_calculo"), 2).alias("base_calculo"), text.strict_decimal(F.col("t.aliquota"), 4).alias("aliquota"), text.strict_decimal(F.col("t.valor"), 2).alias("valor"))


def details(parsed: DataFrame, key: str) -> DataFrame:
    """Extra values as key/value rows."""
    return parsed.select(F.col(key), F.explode("extras").alias("chave", "valor")).withColumn("origem", F.lit("xml"))
