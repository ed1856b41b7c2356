"""Rule dimensions: small fixed tables, joined by broadcast as their size is known."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.fiscal import REGIONS

TOLERANCE = 0.05
TOLERANCE_SHARE = 0.25

# Operation codes, tax situation codes, product classes.
OPERATION_CODES = ("5101", "5102", "5405", "6101", "6108")
SITUATION_CODES = ("00", "10", "20", "40", "41", "60", "90")
SIMPLE_SITUATION_CODES = ("101", "102", "103", "201", "202", "900")
PRODUCT_CLASSES = ("27101932", "30049099", "22030000", "87032310", "84713019")
DEFAULT_RATES = {"PIS": 1.65, "COFINS": 7.60, "IPI": 5.00}


def defaults() -> dict[str, dict[str, str]]:
    """Codes by section, each with a description; the built-in ones have none, a user's file may."""
    sections = {"cfop": OPERATION_CODES, "cst_icms": SITUATION_CODES, "csosn_icms": SIMPLE_SITUATION_CODES, "ncm": PRODUCT_CLASSES, "uf": REGIONS}
    return {name: dict.fromkeys(codes, "") for name, codes in sections.items()}


def _read(path: str) -> dict:
    """The file's sections; none if it is missing, isn't YAML or holds anything else."""
    try:
        import yaml
    except ImportError:
        return {}
    try:
        loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError, yaml.YAMLError):
        return {}
    return loaded if isinstance(loaded, dict) else {}


def load(path: str | None = None) -> dict[str, dict[str, str]]:
    """Rules from a YAML file with the sections of defaults(); a missing file or section counts as empty, no path gives the defaults."""
    if path is None:
        return defaults()
    loaded = _read(path)
    out = {k: {str(a): str(b) for a, b in (loaded.get(k) or {}).items()} for k in ("cfop", "cst_icms", "csosn_icms", "ncm")}
    return out | {"uf": {str(u): str(u) for u in loaded.get("ufs_validas") or ()}}


def dimension(spark: SparkSession, rules: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """kind, code, description."""
    rows = [(kind, code, text) for kind, codes in (rules or defaults()).items() for code, text in codes.items()]
    return spark.createDataFrame(rows, "kind string, code string, description string")
