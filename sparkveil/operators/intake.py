"""Intake of images and documents: what readers of text, faces and codes found on a page decides what is masked, and
the masked raster is made anew, checked, and packed for sending.

Readers are not part of the engine: their findings are input tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkveil.functions.geometry import box
from sparkveil.functions.taxonomy import redacts, severity
from sparkveil.operators.media import FILL, compose, failures, pixels, png
from sparkveil.operators.recognizers import SPAN, STANDARD, Registry, each_span
from sparkveil.operators.vault import mint
from sparkveil.sources.durable import durable
from sparkveil.sources.shipping import ship

#: Limits of a page, its file and what is sent of it.
MOST_LINES, MOST_CODES, MOST_FILE, MOST_PIXELS, MOST_SENT, MOST_EDGE, MOST_PAGES = 400, 16, 20 * 1024 * 1024, 6_000_000, 1_000_000, 1600, 50
# fixed values: words that tell of an identity document and of a signature
IDENTITY = r"(?i)aadhaar|aadhar|passport|voter\s*id|driving\s+licen[cs]e|identity\s+card|government\s+id"
SIGNATURE = r"(?i)\bsignature\b|\bsigned by\b"
_FULL = 2**31 - 1


def file_refusal(size: Column, width: Column, height: Column, n_pages: Column, page: Column) -> Column:
    """Why a file is not taken in: empty, too_large, no_dimensions, too_many_pixels or no_such_page; null if it is."""
    known = (width >= 1) & (height >= 1)
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > MOST_FILE, "too_large").when(~F.coalesce(known, F.lit(False)), "no_dimensions")
        .when(width.cast("long") * height > MOST_PIXELS, "too_many_pixels").when((n_pages > MOST_PAGES) | (page < 1) | (page > n_pages), "no_such_page")
    )


def code_box(points: Column, width: Column, height: Column, square: Column) -> Column:
    """The box to mask for a code read at ``points`` (ARRAY<STRUCT<x, y>>), grown and inside the image.

    A square code's points are its finders' centres: the fourth corner is added and 30 percent of its extent and 4
    pixels around; a bar code gets 4 pixels. Points that can't be used give the whole image.
    """
    usable = F.coalesce((F.size(points) > 0) & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])) & (~square | (F.size(points) >= 3)), F.lit(False))

    def side(name: str, most: Column) -> Column:
        at = lambda i: F.get(points, F.lit(i))[name]
        values = F.transform(points, lambda p: p[name])
        values = F.when(square, F.concat(values, F.array(at(0) + at(2) - at(1)))).otherwise(values)
        return F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"), most.cast("double").alias("most"))

    x, y = side("x", width), side("y", height)
    around = F.when(square, F.ceil(F.greatest(x["hi"] - x["lo"], y["hi"] - y["lo"]) * 0.3) + 4).otherwise(4)
    low = lambda s: F.greatest(F.lit(0.0), F.floor(s["lo"] - around).cast("double"))
    high = lambda s: F.least(s["most"], F.ceil(s["hi"] + around).cast("double"))
    grown = box(low(x), low(y), F.greatest(F.lit(1.0), high(x) - low(x)), F.greatest(F.lit(1.0), high(y) - low(y)))
    return F.when(usable, grown).otherwise(box(F.lit(0), F.lit(0), width, height))


def inspect_pages(pages: DataFrame, texts: DataFrame, faces: DataFrame, codes: DataFrame, registry: Registry | None = None) -> dict[str, DataFrame]:
    """What is masked on each page, and what may be told of it.

    ``pages`` has page_id, kind (image or pdf), width, height and hint (an upload field asks for an identity document);
    ``texts`` has page_id, pos, text and box; a page with more than MOST_LINES of them is masked whole, and only that many are read.
    ``faces`` and ``codes`` have page_id, pos and box. More than MOST_CODES codes mask the whole page, as one.

    report: counts, cues, the treatment, and counts by class; masks: page_id, pos, label, box; tokens: the only words of
    the page that may leave, its typed tokens. A page is masked whole where a cue or a code can't be placed, where
    nothing was recognized, and if it is a pdf.
    """
    registry = registry or STANDARD
    # how large tables get that were made from a small one can't be told before: a page's rows meet by shuffles, never as a broadcast
    meet = lambda df: df.hint("merge")
    at = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    lines = texts.withColumn("nth", at).filter(f"nth <= {MOST_LINES + 1}")  # one more tells that there are too many
    lines = lines.withColumn("spans", F.when(F.col("nth") <= MOST_LINES, registry.analyze("text", 0.3)).otherwise(F.array().cast(f"array<{SPAN}>")))
    strong = F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: (s["confidence"] >= 0.5) & (severity(s["cls"]) != "medium")), lambda s: s["cls"])))
    every = lines.withColumn("strong", strong)
    read = F.col("nth") <= MOST_LINES
    lines = every.filter(read)
    told = every.groupBy("page_id").agg(
        F.count_if(read).alias("n_lines"), F.count_if(F.size("strong") > 0).alias("n_strong"), F.bool_or(read & F.col("text").rlike(IDENTITY)).alias("cue_identity"), F.bool_or(read & F.col("text").rlike(SIGNATURE)).alias("cue_signature"),
        F.bool_or(read & (F.length(F.regexp_replace("text", "[^0-9]", "")) >= 8)).alias("has_number"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("spans", lambda s: s["cls"]))))).alias("seen_classes"), F.bool_or(~read).alias("too_long"),
    )
    counted = lambda df, to: df.groupBy("page_id").agg(F.count("*").alias(to))
    rows = pages.join(meet(told), "page_id", "left").join(meet(counted(faces, "n_faces")), "page_id", "left").join(meet(counted(codes, "n_found")), "page_id", "left")
    rows = rows.fillna(0, ["n_lines", "n_strong", "n_faces", "n_found"]).fillna(False, ["cue_identity", "cue_signature", "has_number", "too_long"])
    rows = rows.withColumn("n_codes", F.when(F.col("n_found") > MOST_CODES, 1).otherwise(F.col("n_found"))).withColumn("pdf", F.col("kind") == "pdf")
    rows = rows.withColumn("n_faces", F.when(F.col("pdf"), 0).otherwise(F.col("n_faces"))).withColumn("identity", F.coalesce("hint", F.lit(False)) | F.col("cue_identity"))
    found = F.when(F.col("identity"), F.col("n_lines")).otherwise(F.col("n_strong")) + F.col("n_faces") + F.col("n_codes")
    rows = rows.withColumn("n_found_all", found)
    no_code, no_number = F.coalesce("hint", F.lit(False)) & (F.col("n_codes") == 0), F.col("identity") & ~F.col("has_number")
    nothing = (F.col("n_lines") == 0) & (F.col("n_faces") == 0) & (F.col("n_codes") == 0)
    whole = F.col("pdf") | F.col("too_long") | F.col("cue_signature") | no_code | no_number | (F.col("identity") & (found == 0)) | nothing
    label = F.when(F.col("pdf"), "PDF_PAGE").when(F.col("identity"), "PII:ID_DOCUMENT").when(F.col("cue_signature"), "PII:SIGNATURE").otherwise("UNEXPLAINED")
    treatment = (
        F.when(F.col("pdf"), "pdf_masked").when(F.col("too_long"), "too_many_lines").when(no_code, "code_not_found").when(no_number, "number_not_found").when(whole & (F.col("identity") | F.col("cue_signature")), "cue_not_placed")
        .when(whole, "nothing_recognized").when(F.col("identity"), "all_lines").otherwise("selective")
    )
    rows = rows.withColumn("whole", whole).withColumn("label", label).withColumn("treatment", treatment)
    rows = durable(rows)  # one a page; the report and the masks are made from it

    marked = lines.join(meet(rows.filter("not whole").select("page_id", "identity")), "page_id").filter(F.col("identity") | (F.size("strong") > 0))
    name = F.when(F.size("strong") > 0, F.array_join(F.transform("strong", lambda c: F.concat(F.lit("PII:"), c)), " + ")).otherwise("PII:ID_DOCUMENT")
    masks = marked.select("page_id", "pos", name.alias("label"), "box")
    seen = rows.filter("not whole").select("page_id", "pdf", "width", "height", "n_found")
    masks = masks.unionByName(faces.join(meet(seen.filter("not pdf").select("page_id")), "page_id").select("page_id", "pos", F.lit("PII:FACE").alias("label"), "box"))
    few = codes.join(meet(seen.filter(f"n_found <= {MOST_CODES}").select("page_id")), "page_id").select("page_id", "pos", F.lit("PII:QR_BARCODE").alias("label"), "box")
    many = seen.filter(f"n_found > {MOST_CODES}").select("page_id", F.lit(_FULL).alias("pos"), F.lit("PII:QR_BARCODE").alias("label"), box(F.lit(0), F.lit(0), F.col("width"), F.col("height")).alias("box"))
    full = rows.filter("whole").select("page_id", F.lit(_FULL).alias("pos"), "label", box(F.lit(0), F.lit(0), F.col("width"), F.col("height")).alias("box"))
    masks = masks.unionByName(few).unionByName(many).unionByName(full)

    typed = each_span(lines, "page_id", "pos", spans=F.filter("spans", lambda s: (s["confidence"] >= 0.5) & redacts("shield", s["cls"])))
    typed = typed.select("page_id", "pos", F.col("s.cls").alias("cls"), F.coalesce("s.normalized", "s.text").alias("value"), F.struct("pos", F.col("s.start")).alias("seq"))
    vault = mint(typed, "page_id")
    own = typed.join(meet(vault.select("page_id", "cls", "value", "token", "overflow", "ordinal")), ["page_id", "cls", "value"]).filter("not overflow")
    tokens = own.groupBy("page_id", "pos").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"])), " ").alias("text"))
    by_text = own.select("page_id", "pos", "cls", "token").distinct().groupBy("page_id", "cls").agg(F.count("*").alias("n"))
    pixel = [("FACE", F.col("n_faces")), ("QR_BARCODE", F.col("n_codes")), ("SIGNATURE", F.col("cue_signature").cast("long")), ("ID_DOCUMENT", F.col("identity").cast("long"))]
    by_pixel = rows.select("page_id", F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), n.cast("long").alias("n")) for c, n in pixel])).alias("x")).select("page_id", "x.*").filter("n > 0")
    classes = by_text.unionByName(by_pixel).groupBy("page_id", "cls").agg(F.sum("n").alias("n"))
    classes = classes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("by_class"))  # of 26 classes
    n_masks = F.when(F.col("whole"), 1).otherwise(F.col("n_found_all")).cast("long")
    report = rows.join(meet(classes), "page_id", "left").select(
        "page_id", "n_lines", "n_faces", "n_codes", F.coalesce("seen_classes", F.array().cast("array<string>")).alias("seen_classes"), "identity", F.col("cue_signature").alias("signature"), n_masks.alias("n_masks"), "treatment",
        F.coalesce("by_class", F.array().cast("array<struct<cls:string,n:bigint>>")).alias("by_class"),
    )
    return {"report": report, "masks": masks, "tokens": tokens}


# ---------------------------------------------------------------- rasters


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each new pixel is the mean of the old ones that it covers, at least one."""
    h, w = image.shape[:2]
    ys = np.linspace(0, h, height + 1).astype(int)
    xs = np.linspace(0, w, width + 1).astype(int)
    total = np.zeros((h + 1, w + 1, image.shape[2]), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    y1, x1 = np.maximum(ys[1:], ys[:-1] + 1), np.maximum(xs[1:], xs[:-1] + 1)
    y0, x0 = ys[:-1], xs[:-1]
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    sums = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return (sums // area[..., None]).astype(np.uint8)


def sendable(image: np.ndarray, rects: list[dict], most_edge: int = MOST_EDGE, most_bytes: int = MOST_SENT) -> tuple[bytes, np.ndarray]:
    """The masked image as a PNG that fits, and its pixels: it is made smaller, masked again and checked until it does."""
    first = compose(image, rects)
    if failures(first, rects, stamp=FILL):
        raise ValueError("a masked pixel shows")
    h, w = image.shape[:2]
    scale = min(1.0, most_edge / max(w, h))
    for _ in range(9):
        width, height = max(1, int(w * scale)), max(1, int(h * scale))
        out, own = first, rects
        if (width, height) != (w, h):
            own = [{"x": r["x"] * width / w, "y": r["y"] * height / h, "w": r["w"] * width / w, "h": r["h"] * height / h} for r in rects]
            out = compose(resized(first, width, height), own)
        made = png(out)
        if len(made) <= most_bytes:
            if failures(unpacked(made), own, stamp=FILL):
                raise ValueError("a masked pixel shows after encoding")
            return made, out
        scale *= 0.75
    raise ValueError("the image does not fit")


def unpacked(data: bytes) -> np.ndarray:
    """The pixels of a PNG that ``media.png`` made."""
    at, body, width, height = 8, b"", 0, 0
    while at < len(data):
        n, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if name == b"IHDR":
            width, height = int.from_bytes(data[at + 8 : at + 12], "big"), int.from_bytes(data[at + 12 : at + 16], "big")
        elif name == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)
    return np.concatenate([rows, np.full((height, width, 1), 255, np.uint8)], axis=2)


def raster_pdf(image: np.ndarray) -> bytes:
    """A PDF of one page that shows nothing but the pixels."""
    h, w = image.shape[:2]
    shown = zlib.compress(image[..., :3].tobytes())
    draw = b"q %d 0 0 %d 0 0 cm /P Do Q" % (w, h)
    parts = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Contents 5 0 R/Resources<</XObject<</P 4 0 R>>>>>>" % (w, h),
        b"<</Type/XObject/Subtype/Image/ColorSpace/DeviceRGB/BitsPerComponent 8/Width %d/Height %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (w, h, len(shown), shown), b"<</Length %d>>\nstream\n%s\nendstream" % (len(draw), draw),
    ]
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, table, len(parts) + 1, len(out))


def encode_masked(images: DataFrame, most_edge: int = MOST_EDGE, most_bytes: int = MOST_SENT) -> DataFrame:
    """``images`` (id, width, height, data, rects) as what may be sent: png, its size, and the same page as a PDF.

    An image that can't be made safe or small enough has a null png and tells why; it does not stop the others.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, w, h, d, rects in zip(b["id"], b["width"], b["height"], b["data"], b["rects"], strict=True):
                try:
                    made, out = sendable(pixels(d, w, h), [r if isinstance(r, dict) else r.asDict() for r in (rects if rects is not None else [])], most_edge, most_bytes)
                    row = (i, made, out.shape[1], out.shape[0], raster_pdf(out), None)
                except ValueError as e:
                    row = (i, None, None, None, None, str(e))
                yield pd.DataFrame([row], columns=["id", "png", "width", "height", "pdf", "refused"]).astype({"width": "Int32", "height": "Int32"})

    return images.select("id", "width", "height", "data", "rects").mapInPandas(run, "id long, png binary, width int, height int, pdf binary, refused string")


def payload(content: Column) -> Column:
    """Bytes as they are sent: data in base64, and the digest of that text."""
    data = F.base64(content)
    return F.struct(data.alias("data"), F.sha2(data.cast("binary"), 256).alias("sha256"))
