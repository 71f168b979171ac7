"""Eighteen labelled page captures, all personal data synthetic: regions and ground truth as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkveil.operators.policy import REGION

TRUTH = "capture_id string, slice string, g int, cls string, severity string, must_redact boolean, box struct<x:double,y:double,w:double,h:double>"


def text(content, *box):
    return {"role": "text", "raw_text": content, "box": box}


def field(label, value, *box, cls=None):
    return {"role": "textbox", "label": label, "raw_value": value, "structural_class": cls, "box": box}


def seen(label, cls, *box, role="image", explained=True):
    return {"role": role, "label": label, "visual_class": cls, "source": "vision", "explained": explained, "box": box}


# fixed values: captures with their regions, and of each ground truth its class, severity, whether it must be redacted, and box
CAPTURES = {
    ("gov_form_1", "government"): (
        [field("Aadhaar Number", "9999 4105 7058", 40, 100, 280, 36), field("PAN", "ABCPE1234F", 40, 160, 280, 36), field("PIN Code", "", 40, 220, 140, 36), seen("Applicant photo", "FACE", 400, 100, 96, 120), {"role": "button", "label": "Submit Application", "risk": "state_changing", "box": (40, 300, 180, 40)}],
        [("AADHAAR", "invariant", True, 40, 100, 280, 36), ("PAN", "invariant", True, 40, 160, 280, 36), ("FACE", "invariant", True, 400, 100, 96, 120)],
    ),
    ("gov_notice_2", "government"): (
        [text("Notice for holder of Aadhaar 999941057058 regarding verification.", 40, 100, 600, 22), text("Registered address: 14 Nehru Marg, Gandhinagar", 40, 140, 600, 22), text("Notice number 784512369014 issued under section 12.", 40, 180, 600, 22)],
        [("AADHAAR", "invariant", True, 40, 100, 600, 22), ("ADDRESS", "high", True, 40, 140, 600, 22), ("AADHAAR", "invariant", False, 40, 180, 600, 22)],
    ),
    ("banking_dashboard_1", "banking"): (
        [text("Savings A/C 123456789012", 40, 100, 300, 22), text("Balance: ₹48,230.11", 40, 140, 300, 22), text("Branch IFSC SBIN0005943", 40, 180, 300, 22), text("Customer care 1800-000-000 toll free", 40, 220, 300, 22), text("Transaction ref 784512369014 processed", 40, 260, 340, 22)],
        [("BANK_ACCOUNT", "high", True, 40, 100, 300, 22), ("AMOUNT", "high", True, 40, 140, 300, 22), ("IFSC", "high", True, 40, 180, 300, 22), ("PHONE_IN", "high", False, 40, 220, 300, 22), ("AADHAAR", "invariant", False, 40, 260, 340, 22)],
    ),
    ("banking_transfer_2", "banking"): (
        [field("Beneficiary UPI ID", "ramesh.kumar@okicici", 40, 100, 300, 36), field("Card Number", "4111 1111 1111 1111", 40, 160, 300, 36, cls="CARD_NUMBER"), field("Registered Mobile", "+91 98765 43210", 40, 220, 300, 36, cls="PHONE_IN")],
        [("UPI_VPA", "high", True, 40, 100, 300, 36), ("CARD_NUMBER", "invariant", True, 40, 160, 300, 36), ("PHONE_IN", "high", True, 40, 220, 300, 36)],
    ),
    ("payments_upi_1", "payments"): (
        [seen(None, "QR_BARCODE", 200, 100, 180, 180), text("Pay to merchant@ybl", 200, 300, 200, 22), text("Amount due Rs. 2,000", 200, 340, 200, 22)],
        [("QR_BARCODE", "invariant", True, 200, 100, 180, 180), ("UPI_VPA", "high", True, 200, 300, 200, 22), ("AMOUNT", "high", True, 200, 340, 200, 22)],
    ),
    ("mail_inbox_1", "mail"): (
        [text("From anita.desai@example.com : Quarterly report attached", 40, 100, 600, 22), text("From hr@company.example.com : call me on 9876543210", 40, 140, 600, 22), text("From Anita Desai : lunch tomorrow?", 40, 180, 600, 22)],
        [("EMAIL", "high", True, 40, 100, 600, 22), ("EMAIL", "high", True, 40, 140, 600, 22), ("PHONE_IN", "high", True, 40, 140, 600, 22), ("PERSON_NAME", "medium", True, 40, 180, 600, 22)],
    ),
    ("mail_compose_2", "mail"): (
        [field("To", "ramesh.kumar@gmail.com", 40, 100, 400, 32, cls="EMAIL"), field("Message body", "As discussed my aadhaar is 9999 4105 7058, please process.", 40, 150, 600, 200)],
        [("EMAIL", "high", True, 40, 100, 400, 32), ("AADHAAR", "invariant", True, 40, 150, 600, 200)],
    ),
    ("commerce_checkout_1", "commerce"): (
        [field("Street Address", "12 MG Road", 40, 100, 400, 36, cls="ADDRESS"), field("PIN Code", "380015", 40, 160, 160, 36), field("Card Number", "5555 5555 5555 4444", 40, 220, 300, 36, cls="CARD_NUMBER"), text("Order 784512369014 : 2 items", 40, 280, 300, 22)],
        [("ADDRESS", "high", True, 40, 100, 400, 36), ("PIN_CODE", "medium", True, 40, 160, 160, 36), ("CARD_NUMBER", "invariant", True, 40, 220, 300, 36), ("AADHAAR", "invariant", False, 40, 280, 300, 22)],
    ),
    ("social_profile_1", "social"): (
        [seen("Profile photo", "FACE", 40, 100, 120, 120), text("DOB: 12/05/1994", 40, 260, 200, 22), text("Member since 01/2020", 40, 300, 200, 22)],
        [("FACE", "invariant", True, 40, 100, 120, 120), ("DOB", "high", True, 40, 260, 200, 22), ("DOB", "high", False, 40, 300, 200, 22)],
    ),
    ("healthcare_portal_1", "healthcare"): (
        [text("Patient contact: 9876543210, mail anita.desai@example.com", 40, 100, 600, 22), text("Next appointment 24/10/2026 at 10:30", 40, 140, 400, 22)],
        [("PHONE_IN", "high", True, 40, 100, 600, 22), ("EMAIL", "high", True, 40, 100, 600, 22), ("DOB", "high", False, 40, 140, 400, 22)],
    ),
    ("enterprise_crm_1", "enterprise"): (
        [text("Customer: reach at 9123456789 or sales.lead@client.example.in", 40, 100, 600, 22), text("GSTIN 27AAPFU0939F1ZV on file", 40, 140, 400, 22), text("Handled by employee 40100234", 40, 180, 400, 22)],
        [("PHONE_IN", "high", True, 40, 100, 600, 22), ("EMAIL", "high", True, 40, 100, 600, 22), ("GSTIN", "high", True, 40, 140, 400, 22), ("BANK_ACCOUNT", "high", False, 40, 180, 400, 22)],
    ),
    ("hard_cases_1", "hard"): (
        [seen(None, None, 40, 100, 400, 250, role="iframe", explained=False), seen(None, None, 500, 100, 300, 250, role="canvas", explained=False), text("9999 4105", 40, 400, 90, 20), text("7058", 140, 400, 45, 20), text("Vehicle GJ 01 AB 1234 parked in bay 4", 40, 440, 400, 20)],
        [("UNEXPLAINED", "invariant", True, 40, 100, 400, 250), ("UNEXPLAINED", "invariant", True, 500, 100, 300, 250), ("AADHAAR", "invariant", True, 40, 400, 90, 20), ("AADHAAR", "invariant", True, 140, 400, 45, 20), ("VEHICLE_REG", "high", True, 40, 440, 400, 20)],
    ),
    ("adv_formats_1", "adversarial"): (
        [text("Aadhaar on file: 8473–2619–0458", 40, 100, 400, 22), text("Card 4539-1488-0343-6467 charged", 40, 140, 400, 22), text("Fee ₹2000 payable now", 40, 180, 300, 22), text("PAN ABCPE 1234 F verified", 40, 220, 300, 22), text("branch ifsc sbin0005943", 40, 260, 300, 22), text("Call (+91) 98765-43210 for support", 40, 300, 400, 22)],
        [("AADHAAR", "invariant", True, 40, 100, 400, 22), ("CARD_NUMBER", "invariant", True, 40, 140, 400, 22), ("AMOUNT", "high", True, 40, 180, 300, 22), ("PAN", "invariant", True, 40, 220, 300, 22), ("IFSC", "high", True, 40, 260, 300, 22), ("PHONE_IN", "high", True, 40, 300, 400, 22)],
    ),
    ("adv_evasion_2", "adversarial"): (
        [text("code 5 2 0 9 8 7 1 6 3 4 9 9 noted", 40, 100, 500, 22), text("backup card 5 5 5 5 5 5 5 5 5 5 5 5 4 4 4 4", 40, 140, 500, 22), text("write to priya [at] example [dot] com", 40, 180, 400, 22), text("registered as 27aapfu0939f1zv", 40, 220, 400, 22)],
        [("AADHAAR", "invariant", True, 40, 100, 500, 22), ("CARD_NUMBER", "invariant", True, 40, 140, 500, 22), ("EMAIL", "high", True, 40, 180, 400, 22), ("GSTIN", "high", True, 40, 220, 400, 22)],
    ),
    ("hindi_context_3", "government"): (
        [text("पिन कोड: 110001", 40, 100, 300, 22), text("खाता संख्या 123456789012", 40, 140, 400, 22), text("आधार 931572486013", 40, 180, 400, 22), text("मोबाइल 9876501234", 40, 220, 300, 22)],
        [("PIN_CODE", "medium", True, 40, 100, 300, 22), ("BANK_ACCOUNT", "high", True, 40, 140, 400, 22), ("AADHAAR", "invariant", True, 40, 180, 400, 22), ("PHONE_IN", "high", True, 40, 220, 300, 22)],
    ),
    ("table_kyc_4", "government"): (
        [text("Aadhaar Number", 40, 100, 160, 22), text("785093142627", 220, 100, 160, 22), text("PAN", 40, 140, 160, 22), text("AABCU9603R", 220, 140, 160, 22), text("Date of Birth", 40, 180, 160, 22), text("31/01/1990", 220, 180, 160, 22)],
        [("AADHAAR", "invariant", True, 220, 100, 160, 22), ("PAN", "invariant", True, 220, 140, 160, 22), ("DOB", "high", True, 220, 180, 160, 22)],
    ),
    ("adv_negatives_5", "adversarial"): (
        [text("Ref 8473–2619–0459 issued", 40, 100, 400, 22), text("txn 4539 1488 0343 6468 logged", 40, 140, 400, 22), text("code 27AAPFU0939F1ZX invalid", 40, 180, 400, 22), text("batch 7 8 4 5 1 2 3 6 9 0 1 4 shipped", 40, 220, 500, 22), text("employee 40100234 assigned", 40, 260, 300, 22)],
        [("AADHAAR", "invariant", False, 40, 100, 400, 22), ("CARD_NUMBER", "invariant", False, 40, 140, 400, 22), ("GSTIN", "high", False, 40, 180, 400, 22), ("AADHAAR", "invariant", False, 40, 220, 500, 22), ("BANK_ACCOUNT", "high", False, 40, 260, 300, 22)],
    ),
    ("media_gallery_6", "social"): (
        [seen("Team photo", "FACE", 40, 100, 200, 150), seen(None, "FACE", 260, 100, 120, 150), seen("Event pass", "QR_BARCODE", 400, 100, 140, 140)],
        [("FACE", "invariant", True, 40, 100, 200, 150), ("FACE", "invariant", True, 260, 100, 120, 150), ("QR_BARCODE", "invariant", True, 400, 100, 140, 140)],
    ),
}


def regions(spark: SparkSession) -> DataFrame:
    """All captures' regions, in the schema of the sanitizer; page_id is the capture."""
    rows = []
    for (capture, _), (own, _) in CAPTURES.items():
        for pos, r in enumerate(own, 1):
            box = tuple(map(float, r["box"]))
            rows.append((capture, pos, f"e{pos}", r["role"], r.get("label"), box, r.get("source", "dom"), 0.97, ["structural:role"], r.get("explained", True), r.get("raw_value"), r.get("raw_text"), r.get("structural_class"), r.get("visual_class"), None, r.get("risk")))
    return spark.createDataFrame(rows, REGION)


def truth(spark: SparkSession) -> DataFrame:
    rows = [(c, s, g, cls, severity, must, tuple(map(float, box))) for (c, s), (_, own) in CAPTURES.items() for g, (cls, severity, must, *box) in enumerate(own)]
    return spark.createDataFrame(rows, TRUTH)


def predictions(sanitized: dict[str, DataFrame]) -> DataFrame:
    """What a sanitizer's output claims: capture_id, p, cls, box. Tokens of values and labels count each, those of a
    free text once a class; masked pixels without a token are UNEXPLAINED or REDACTED."""
    elements, texts = sanitized["elements"], sanitized["untrusted_text"]
    token = "PII:([A-Z_]+)#[0-9]+"
    kind = F.col("value.kind")
    of_value = F.when(kind == "unexplained_masked", "UNEXPLAINED").when(kind.isin("placeholder", "redacted"), F.coalesce(F.nullif(F.regexp_extract("value.token", token, 1), F.lit("")), F.lit("REDACTED")))
    values = elements.select("page_id", "pos", F.lit(0).alias("channel"), of_value.alias("cls"), "box").filter("cls is not null")
    labels = elements.filter("value is not null").select("page_id", "pos", F.lit(1).alias("channel"), F.explode(F.regexp_extract_all(F.coalesce("label", F.lit("")), F.lit(token), F.lit(1))).alias("cls"), "box")
    found = texts.select("page_id", "pos", F.lit(2).alias("channel"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(token), F.lit(1)))).alias("cls")).join(elements.select("page_id", "pos", "box"), ["page_id", "pos"])
    rows = values.unionByName(labels).unionByName(found)
    order = W.partitionBy("page_id").orderBy("pos", "channel", "cls")
    return rows.select(F.col("page_id").alias("capture_id"), F.row_number().over(order).alias("p"), "cls", "box")
