"""Classes of personal data, their severities, tokens and privacy modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: classes and severities
INVARIANT = ("PASSWORD", "OTP", "API_KEY", "AADHAAR", "PAN", "VOTER_ID", "PASSPORT_IN", "DRIVING_LICENCE", "CARD_NUMBER", "BANK_ACCOUNT", "FACE", "SIGNATURE", "QR_BARCODE", "ID_DOCUMENT")
HIGH = ("GSTIN", "VEHICLE_REG", "IFSC", "UPI_VPA", "AMOUNT", "EMAIL", "PHONE_IN", "ADDRESS", "DOB")
MEDIUM = ("PIN_CODE", "PERSON_NAME", "USERNAME")
MODES = ("shield", "fortress", "wireframe")
THRESHOLDS = {"shield": 0.5, "fortress": 0.3, "wireframe": 0.3}
CLASSES = INVARIANT + HIGH + MEDIUM


def table(spark: SparkSession) -> DataFrame:
    """The dimension of 26 classes: cls, severity, legend_key."""
    rows = [(c, s, f"PII:{c}") for s, cs in (("invariant", INVARIANT), ("high", HIGH), ("medium", MEDIUM)) for c in cs]
    return spark.createDataFrame(rows, "cls string, severity string, legend_key string")


def severity(cls: Column) -> Column:
    return F.when(cls.isin(*INVARIANT), "invariant").when(cls.isin(*HIGH), "high").when(cls.isin(*MEDIUM), "medium")


def is_invariant(cls: Column) -> Column:
    return F.coalesce(cls.isin(*INVARIANT), F.lit(False))


def redacts(mode: str, cls: Column) -> Column:
    """Whether ``mode`` redacts a class: the invariant ones always, high ones too in shield, all in the others."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(cls.isin(*INVARIANT, *HIGH) if mode == "shield" else cls.isin(*CLASSES), F.lit(False))


def format_token(cls: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("PII:"), cls, F.lit("#"), ordinal.cast("string"))


def token_class(token: Column) -> Column:
    """The class that a token names; null if it is none, or its class is unknown."""
    cls = F.regexp_extract(token, r"^PII:([A-Z_]+)#([0-9]+)$", 1)
    return F.when(cls.isin(*CLASSES), cls)


def token_ordinal(token: Column) -> Column:
    return F.when(token_class(token).isNotNull(), F.regexp_extract(token, r"#([0-9]+)$", 1).try_cast("long"))


def legend_key(cls: Column) -> Column:
    return F.concat(F.lit("PII:"), cls)
