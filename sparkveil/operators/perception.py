"""Perception of static pages: HTML becomes rows of regions, and rules on them become columns.

Only the tokenising of HTML runs in Python, a page at a time; roles, structural classes, risks and page
kinds are column expressions over its rows. Static HTML has no layout: what is hidden by attribute or
inline style is left out, and boxes are lines of the page's flow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkveil.functions.scalars import origin_class
from sparkveil.sources.shipping import ship

MOST_REGIONS, MOST_TEXTS = 300, 60
ELEMENT = """page_id long, pos int, tag string, role_attr string, type string, name string, elem_id string, placeholder string, autocomplete string, aria_label string,
    href boolean, value string, text string, label_text string, required boolean, disabled boolean, readonly boolean, checked boolean, editable boolean, in_main boolean, in_article boolean,
    invalid boolean, message string, help string, options array<string>"""

_SKIP = {"script", "style", "noscript", "template", "title", "svg"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_OWN = {"input", "textarea", "select", "button", "a", "img", "canvas", "video", "iframe", "embed", "object", "h1", "h2", "h3", "h4", "h5", "h6", "label", "form", "table", "ul", "ol", "li", "dialog", "progress", "fieldset", "p", "article", "main", "td", "th", "div", "span", "section"}
_BLOCKS = {"p", "div", "li", "td", "th", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "tr", "form", "fieldset", "main", "nav", "footer", "header", "aside", "body", "html", "dl", "dt", "dd", "blockquote", "pre"}


#: Elements that may have a shadow root, beside those whose name has a hyphen.
_HOSTS = {"article", "aside", "blockquote", "body", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "p", "section", "span"}
#: Composite widgets: their own options tell their value, and controls inside them are part of them.
_OWNERS, _CHOICES = {"radiogroup", "combobox", "listbox", "textbox"}, {"option", "radio", "checkbox"}
_CONTROLS = {"input", "textarea", "select"}
#: Markup so plain that one pattern tells its tokens as the parser does: texts, end tags, and start tags with quoted attributes. A page
#: with anything else, or with an element whose content is no markup, goes to the parser whole.
_NAME, _NO_MARKUP = "[a-z][a-z0-9-]*+", "(?!(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)[ >])"
_TOKEN = rf'{{0}}[^<]++)|</{{0}}{_NAME})>|<{_NO_MARKUP}{{0}}{_NAME}){{0}}(?: {_NAME}(?:="[^"&<>]*+")?+)*+)>'
_PLAIN, _EACH, _ATTRIBUTES = re.compile("(?:" + _TOKEN.format("(?:") + ")*+"), re.compile(_TOKEN.format("(")), re.compile(rf' ({_NAME})(?:="([^"]*)")?')


class _Open:
    """An element that is open: its tag, row (if it has one), whether it is hidden, and what its text belongs to besides."""

    __slots__ = ("article", "at", "choice", "hidden", "ident", "label", "lit", "main", "owner", "root", "row", "scope", "tag", "told")

    def __init__(self, tag: str, row: dict | None, hidden: bool, ident: str | None, owner: dict | None, choice: dict | None, scope: int, lit: list | None, at: int, around: _Open | None):
        self.tag, self.row, self.hidden, self.ident, self.choice = tag, row, hidden, ident, choice
        self.scope, self.lit, self.at = scope, lit, at  # its tree, the slot it depends on (a chain), the place of the first row inside
        # what the elements around it in its tree, and itself, hand to those inside: whether any takes texts by id or choice, the owner and the label's row that are nearest
        self.told = ident is not None and ident != "" or choice is not None or (around is not None and around.told)
        self.owner = owner if owner is not None or around is None else around.owner
        self.label = row if tag == "label" else around.label if around is not None else None
        self.main = tag == "main" or (around is not None and around.main)
        self.article = tag == "article" or (around is not None and around.article)
        self.root: dict = {"slots": None}  # the slots of its shadow root, if it has one


class _Walker(HTMLParser):
    """A page's elements in pre-order, each with the text that is directly its own, and controls with label, value and feedback.

    An open shadow root that is declared in the page (a template with shadowrootmode) comes after its host and before the host's own
    content, of which only what a slot takes is seen. Ids, labels and owners hold within their tree. A template without root is inert.
    """

    def __init__(self, page_id: int):
        super().__init__(convert_charrefs=True)
        self.page_id, self.rows, self.open, self.skipped, self.inert, self.scopes = page_id, [], [], 0, 0, 0
        self.said: dict[tuple[int, str], list[str]] = {}  # texts by tree and id

    def read(self, html: str) -> list[dict]:
        """The rows of a page: its tokens by one pattern if it is plain, else by the parser."""
        if _PLAIN.fullmatch(html):
            for text, end, tag, attributes in _EACH.findall(html):
                if text:
                    self.handle_data(unescape(text) if "&" in text else text)
                elif end:
                    self.handle_endtag(end)
                else:
                    self.begin(tag, dict(_ATTRIBUTES.findall(attributes)) if attributes else {})
        else:
            self.feed(html)
            self.close()
        return self.result()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.begin(tag, {k: (v if v is not None else "") for k, v in attrs})

    def begin(self, tag: str, a: dict[str, str]) -> None:
        host = self.open[-1] if self.open else None
        if self.inert:
            self.inert += tag == "template"
            return
        scope, lit = (host.scope, host.lit) if host else (0, None)
        if tag == "template":
            if a.get("shadowrootmode") == "open" and host is not None and host.root["slots"] is None and not self.skipped and ("-" in host.tag or host.tag in _HOSTS):
                host.root["slots"] = set()
                self.scopes += 1
                self.open.append(_Open(tag, None, host.hidden, None, None, None, self.scopes, lit, len(self.rows), None))
            else:
                self.inert = 1
            return
        if host is not None and host.tag != "template":
            lit = [lit, host.root, a.get("slot", ""), None]  # of the element around, its parent's root, its slot, whether it is seen
        if tag == "slot" and scope:
            at = max(k for k, o in enumerate(self.open) if o.tag == "template")
            self.open[at - 1].root["slots"].add(a.get("name", ""))
        if tag in _SKIP:
            self.skipped += tag not in _VOID
            return
        if tag in _BLOCKS:  # a paragraph ends where a block begins
            while self.open and self.open[-1].tag == "p":
                self.open.pop()
        if tag == "option" and self.open and self.open[-1].tag == "option":
            self.open.pop()
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or a.get("type") == "hidden" or "display:none" in a.get("style", "").replace(" ", "").lower() or (bool(self.open) and self.open[-1].hidden)
        outer = self.open[-1] if self.open and self.open[-1].tag != "template" else None  # the element around it in its tree
        around = outer.owner if outer is not None else None
        part = around is not None and (tag in _CONTROLS or a.get("role") in _CHOICES)
        choice, row = None, None
        if around is not None and (tag == "option" or a.get("role") in _CHOICES or (tag == "input" and a.get("type") in ("radio", "checkbox"))):
            chosen = "selected" in a or "checked" in a or a.get("aria-selected") == "true" or a.get("aria-checked") == "true"
            choice = {"text": [], "label": a.get("aria-label") or a.get("label"), "chosen": chosen and a.get("aria-disabled") != "true", "value": a.get("value"), "hidden": hidden}
            around["choices"].append(choice)
        elif part and not hidden and around["nested"] is None:
            around["nested"] = a.get("value", "") if tag == "input" else []
        if not hidden and not part and (tag in _OWN or "role" in a):
            row = {
                "page_id": self.page_id, "pos": len(self.rows), "tag": tag, "role_attr": a.get("role"), "type": a.get("type", "").lower() or None, "name": a.get("name"), "elem_id": a.get("id"),
                "placeholder": a.get("placeholder"), "autocomplete": a.get("autocomplete", "").lower() or None, "aria_label": a.get("aria-label") or a.get("title") or a.get("alt"), "href": "href" in a,
                "value": a.get("value"), "text": [], "label_text": a.get("for"), "required": "required" in a or a.get("aria-required") == "true", "disabled": "disabled" in a, "readonly": "readonly" in a,
                "checked": "checked" in a, "editable": a.get("contenteditable") in ("", "true"), "in_main": outer is not None and outer.main, "in_article": outer is not None and outer.article,
                "invalid": a.get("aria-invalid") == "true", "message": a.get("aria-errormessage", ""), "help": a.get("aria-describedby", ""), "options": None,
                # used while walking
                "choices": [], "nested": None, "labelled": a.get("aria-labelledby", ""), "valuetext": a.get("aria-valuetext"), "wrap": outer.label if outer is not None else None, "scope": scope, "lit": lit,
            }
            self.rows.append(row)
        owner = row if row is not None and (tag == "select" or a.get("role") in _OWNERS) else None
        if tag not in _VOID:
            self.open.append(_Open(tag, row, hidden, a.get("id"), owner, choice, scope, lit, len(self.rows), outer))

    def handle_endtag(self, tag: str) -> None:
        if self.inert:
            self.inert -= tag == "template"
            return
        if tag == "template":
            at = max((k for k, o in enumerate(self.open) if o.tag == "template"), default=None)
            if at is not None:  # the root's rows go before what the host has had so far
                first, begun = self.open[at - 1].at, self.open[at].at
                self.rows[first:] = self.rows[begun:] + self.rows[first:begun]
                del self.open[at:]
            return
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == "template":  # ends in a tree concern that tree
                break
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.skipped or self.inert or not data.strip() or (self.open and self.open[-1].hidden):
            return
        if self.open and self.open[-1].told:
            for o in reversed(self.open):
                if o.tag == "template":
                    break
                if o.ident:
                    self.said.setdefault((o.scope, o.ident), []).append(data)
                if o.choice is not None:
                    o.choice["text"].append(data)
        if self.open and self.open[-1].tag == "textarea" and self.open[-1].row is None:
            around = self.open[-1].owner
            if around is not None and isinstance(around["nested"], list):
                around["nested"].append(data)
        for o in reversed(self.open):
            if o.tag == "template":
                break
            if o.row is not None and (o.tag in _BLOCKS or o.tag in ("label", "button", "a", "option", "textarea")):
                o.row["text"].append(data)
                if o.tag in _BLOCKS:
                    break

    def _named(self, scope: int, ids: str) -> list[str]:
        return [t for i in ids.split() if (t := " ".join(" ".join(self.said.get((scope, i), [])).split()))]

    def _value(self, r: dict) -> str | None:
        """The value of a control: of a file field nothing, of choices the labels of the chosen ones."""
        if r["tag"] == "input":
            return "" if r["type"] == "file" else r["value"]
        if r["tag"] == "textarea":
            return r["text"] or ""
        if r["tag"] != "select" and r["role_attr"] not in _OWNERS:
            return r["text"] if r["editable"] else r["value"]
        named = [(c["label"] or " ".join(" ".join(c["text"]).split()), c) for c in r["choices"] if not c["hidden"]]
        r["options"] = [n for n, _ in named if n] or None
        chosen = [(n, c) for n, c in named if c["chosen"]]
        if r["tag"] == "select" and not chosen:
            chosen = named[:1]  # what a browser shows
        if r["tag"] == "select":
            chosen = [(n, c) for n, c in chosen if c["value"] != ""]
        if chosen or r["tag"] == "select":
            return ", ".join(dict.fromkeys(n for n, _ in chosen))
        if r["nested"] is not None:
            return " ".join("".join(r["nested"]).split()) if isinstance(r["nested"], list) else r["nested"]
        return r["text"] if r["editable"] else r["valuetext"]

    @staticmethod
    def _seen(lit: list | None) -> bool:
        """Whether every slot that an element depends on is there; each link of the chain is looked at once."""
        above = []
        while lit is not None and lit[3] is None:
            above.append(lit)
            lit = lit[0]
        seen = lit is None or lit[3]
        for link in reversed(above):
            seen = link[3] = seen and (link[1]["slots"] is None or link[2] in link[1]["slots"])
        return seen

    def result(self) -> list[dict]:
        self.rows = [r for r in self.rows if self._seen(r["lit"])]
        for k, r in enumerate(self.rows):
            r["pos"] = k
            r["text"] = (" ".join(" ".join(r["text"]).split()) or None) if r["text"] else None
        named = {}
        for r in self.rows:
            if r["tag"] == "label" and r["label_text"]:
                named.setdefault((r["scope"], r["label_text"]), r["text"])
        for r in self.rows:
            around = r["wrap"]["text"] if r["wrap"] and r["tag"] in _CONTROLS else None
            r["label_text"] = (" ".join(self._named(r["scope"], r["labelled"])) if r["labelled"] else None) or (named.get((r["scope"], r["elem_id"])) if r["elem_id"] and r["tag"] != "label" else None) or around
            if r["tag"] in _CONTROLS or r["role_attr"] in _OWNERS or r["editable"]:
                r["value"] = self._value(r)
            wrong, said = (self._named(r["scope"], r[of]) if r[of] else [] for of in ("message", "help"))
            r["help"] = "\n".join(dict.fromkeys(said)) or None
            r["message"] = ("\n".join(dict.fromkeys(wrong)) or r["help"]) if r["invalid"] else None
        return self.rows


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row of ELEMENT for each visible element of pages (page_id, html), in page order. Null html has none."""
    ship(pages.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(ELEMENT))

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for page, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", html)), strict=True):
                rows += _Walker(int(page)).read(text or "")
                if len(rows) >= 5000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    return pages.select("page_id", html).mapInArrow(run, ELEMENT)


def controls(pages: DataFrame, html: str = "html") -> DataFrame:
    """The form controls of pages with label, value, what is wrong with them, their help and options.

    A composite widget is one control: fields and options inside it are part of it.
    """
    e = elements(pages, html).withColumn("role", role()).filter(F.col("role").isin("textbox", "password", "combobox", "listbox", "checkbox", "radio", "slider", "switch") | (F.col("type") == "file"))
    shown = F.coalesce("label_text", "aria_label", F.when(~_generic(F.col("placeholder")), F.col("placeholder")))
    return e.select("page_id", "pos", "role", shown.alias("label"), F.col("value"), "invalid", "message", "help", F.array_join("options", ", ").alias("options"), "required", "disabled")


def _generic(text: Column) -> Column:
    """Whether a hint inside a field says nothing of the field."""
    return F.coalesce(F.lower(text).rlike("^(enter|type|search|select)?\\W*(here|your answer|value)?$"), F.lit(False))


def role() -> Column:
    """The role of an element: its ARIA role for composite widgets, then its tag, then any other ARIA role."""
    aria, tag, kind = F.col("role_attr"), F.col("tag"), F.col("type")
    by_type = F.when(kind.isin("password", "checkbox", "radio"), kind).when(kind == "range", "slider").when(kind.isin("submit", "button", "image"), "button").otherwise("textbox")
    tags = {"textarea": "textbox", "select": "combobox", "button": "button", "img": "image", "canvas": "canvas", "video": "video", "iframe": "iframe", "embed": "iframe", "object": "iframe", "label": "label", "form": "form", "table": "table", "ul": "list", "ol": "list", "li": "listitem", "dialog": "dialog", "progress": "progressbar"}
    same = ("button", "link", "textbox", "checkbox", "radio", "option", "tab", "menuitem", "dialog", "alert", "switch", "slider", "heading")
    out = F.when(aria == "radiogroup", "combobox").when(aria.isin("combobox", "listbox"), aria).when(tag == "input", by_type).when((tag == "a") & F.col("href"), "link").when(tag.rlike("^h[1-6]$"), "heading")
    for t, r in tags.items():
        out = out.when(tag == t, r)
    out = out.when(F.col("editable"), "textbox").when(aria.isin(*same), aria).when(aria == "searchbox", "textbox").when(aria == "alertdialog", "dialog").when(aria == "img", "image")
    return out.otherwise(F.when(tag.isin("p", "td", "th", "div", "span", "section") & F.col("text").isNotNull(), "text").otherwise("unknown"))


# fixed values: autocomplete hints and patterns of names and labels, in order
AUTOCOMPLETE = {"cc-number": "CARD_NUMBER", "cc-csc": "OTP", "cc-exp": "DOB", "one-time-code": "OTP", "current-password": "PASSWORD", "new-password": "PASSWORD", "email": "EMAIL", "tel": "PHONE_IN", "tel-national": "PHONE_IN", "postal-code": "PIN_CODE", "name": "PERSON_NAME", "given-name": "PERSON_NAME", "family-name": "PERSON_NAME", "street-address": "ADDRESS", "address-line1": "ADDRESS", "address-line2": "ADDRESS", "bday": "DOB", "username": "USERNAME"}
HINTS = (
    ("aadha?ar|uidai|\\buid\\b", "AADHAAR"), ("\\bpan\\b|permanent.?account", "PAN"), ("gstin|\\bgst\\b", "GSTIN"), ("ifsc", "IFSC"), ("\\bupi\\b|vpa", "UPI_VPA"), ("passw|pwd", "PASSWORD"),
    ("\\botp\\b|one.?time", "OTP"), ("account.?(no|num)|acc(oun)?t.?number|a/c", "BANK_ACCOUNT"), ("card.?(no|num)", "CARD_NUMBER"), ("mobile|phone|contact.?num", "PHONE_IN"), ("pin.?code|postal|zip", "PIN_CODE"),
    ("email|e-mail", "EMAIL"), ("date.?of.?birth|\\bdob\\b|birth", "DOB"), ("user.?name|\\blogin\\b", "USERNAME"), ("\\b(?:full|given|family|first|last)?\\s*name\\b", "PERSON_NAME"), ("\\bcity\\b|\\btown\\b|\\blocality\\b", "ADDRESS"), ("address", "ADDRESS"),
)


def structural_class(label: Column) -> Column:
    """The class of personal data that a field's type, autocomplete hint or names tell of; null if none."""
    kind, inp = F.col("type"), F.col("tag") == "input"
    out = F.when(inp & (kind == "password"), "PASSWORD").when(inp & (kind == "email"), "EMAIL").when(inp & (kind == "tel"), "PHONE_IN")
    for hint, cls in AUTOCOMPLETE.items():
        out = out.when(inp & (F.col("autocomplete") == hint), cls)
    said = F.lower(F.concat_ws(" ", "name", "elem_id", "aria_label", label, F.when(inp, F.col("placeholder"))))
    for pattern, cls in HINTS:
        out = out.when(said.rlike(pattern), cls)
    return out


def risk(role_column: Column, label: Column) -> Column:
    submit = F.coalesce((F.col("type") == "submit") | ((F.col("tag") == "button") & F.col("type").isNull()), F.lit(False))
    text = F.lower(F.coalesce(label, F.lit("")))
    found = F.when(submit, "state_changing").when(text.rlike("delete|remove"), "destructive").when(text.rlike("submit|pay|transfer|confirm|apply|proceed|place order|buy|send"), "state_changing")
    return F.when(role_column == "button", found)


def regions(pages: DataFrame, html: str = "html") -> DataFrame:
    """Regions of pages for the sanitizer: at most MOST_REGIONS a page, of these MOST_TEXTS free texts, in page order.

    truncated tells that a page reached the limit. The limits are the operator's own.
    """
    rows = elements(pages, html).withColumn("role", role()).filter("role not in ('unknown', 'form', 'table', 'list')")
    placeholder = F.when(~_generic(F.col("placeholder")), F.col("placeholder"))
    label = F.coalesce("label_text", "aria_label", F.when(F.col("role").isin("button", "link", "heading", "label", "option", "tab"), F.col("text")), placeholder)
    rows = rows.withColumn("label", F.substring(label, 1, 300))
    control = F.col("role").isin("textbox", "password", "combobox", "listbox", "checkbox", "radio", "slider", "switch")
    free = F.col("role").isin("text", "listitem", "heading") & F.col("text").isNotNull()
    from pyspark.sql import Window as W

    page = W.partitionBy("page_id").orderBy("pos")
    rows = rows.filter(control | free | F.col("role").isin("button", "link", "image", "iframe", "canvas", "video", "dialog", "alert"))
    rows = rows.withColumn("nth_text", F.sum(free.cast("int")).over(page)).filter(~free | (F.col("nth_text") <= MOST_TEXTS)).withColumn("nth", F.row_number().over(page))
    rows = rows.withColumn("truncated", F.count("*").over(W.partitionBy("page_id")) >= MOST_REGIONS).filter(F.col("nth") <= MOST_REGIONS)
    box = F.struct(F.lit(0.0).alias("x"), (F.col("nth") * 24.0).alias("y"), F.lit(800.0).alias("w"), F.lit(20.0).alias("h"))
    return rows.select(
        F.col("page_id").cast("string").alias("page_id"), F.col("nth").alias("pos"), F.concat(F.lit("e"), F.col("nth")).alias("id"), "role", "label", box.alias("box"), F.lit("dom").alias("source"), F.lit(0.97).alias("confidence"),
        F.array(F.lit("structural:role")).alias("evidence"), F.lit(True).alias("explained"), F.when(control, F.col("value")).alias("raw_value"), F.when(free, F.col("text")).alias("raw_text"),
        F.when(control, structural_class(F.col("label"))).alias("structural_class"), F.lit(None).cast("string").alias("visual_class"), F.col("type").alias("input_type"), risk(F.col("role"), F.col("label")).alias("risk"), "truncated",
    )


def page_kinds(pages: DataFrame, html: str = "html") -> DataFrame:
    """The kind of each page: form_multi_step, form, article or other; pages without elements are other."""
    e = elements(pages, html)
    fields = F.col("tag").isin("input", "select", "textarea") | F.coalesce(F.col("role_attr").isin("textbox", "combobox", "radio", "checkbox"), F.lit(False))
    counts = e.groupBy("page_id").agg(F.count_if(fields).alias("inputs"), F.count_if(F.col("tag") == "form").alias("forms"), F.count_if((F.col("tag") == "article") | ((F.col("tag") == "p") & F.col("in_main"))).alias("prose"))
    kind = F.when(F.col("inputs") >= 8, "form_multi_step").when((F.col("forms") > 0) | (F.col("inputs") > 0), "form").when(F.col("prose") > 5, "article").otherwise("other")
    return pages.select("page_id").join(counts.select("page_id", kind.alias("page_kind")), "page_id", "left").select("page_id", F.coalesce("page_kind", F.lit("other")).alias("page_kind"))


def origins(pages: DataFrame, url: str = "url") -> DataFrame:
    """The kind of site of each page, from its host name only; a URL without host is other."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", origin_class(host).alias("origin_class"), F.coalesce(F.lower(url).startswith("https://"), F.lit(False)).alias("tls"))
