"""Word lists, phrase tables, patterns, formats and thresholds on which results depend.

They are stated as text, in their natural order, and have no logic of their own.
"""

from __future__ import annotations

# --- Fixed values: document types ------------------------------------------------------------------------------------

DOCUMENT_TYPES = ("invoice", "contract", "resume", "report", "letter", "form")

#: The least confidence with which a type is accepted.
THRESHOLDS = {"invoice": 0.40, "contract": 0.40, "resume": 0.40, "report": 0.35, "letter": 0.35, "form": 0.40}
OTHER_THRESHOLD = 0.35

#: Phrases that point to a type.
SIGNATURES = {
    "invoice": (
        "invoice", "bill to", "invoice number", "invoice date", "payment due", "amount due", "subtotal", "tax", "total", "remit to",
        "purchase order", "po number", "unit price", "qty", "quantity", "line item",
    ),
    "contract": (
        "agreement", "whereas", "hereinafter", "party", "parties", "obligations", "terms and conditions", "governing law", "effective date", "termination",
        "indemnify", "indemnification", "liability", "confidentiality", "breach", "clause", "consideration", "witnesseth", "executed",
    ),
    "resume": (
        "resume", "curriculum vitae", "cv", "experience", "education", "skills", "objective", "summary", "work history", "employment",
        "references", "gpa", "degree", "university", "college", "bachelor", "master", "phd",
    ),
    "report": (
        "executive summary", "introduction", "methodology", "findings", "conclusion", "recommendations", "appendix", "abstract", "background", "scope",
        "analysis", "results", "discussion", "references",
    ),
    "letter": (
        "dear", "sincerely", "regards", "yours truly", "to whom it may concern", "re:", "subject:", "enclosed", "please find", "i am writing",
        "thank you for", "best regards",
    ),
    "form": (
        "please complete", "fill in", "check all that apply", "signature", "date of birth", "social security", "full name", "address", "phone number", "email address",
        "please print", "instructions", "required", "optional", "section",
    ),
}

#: What in a title or in the keywords points to a type.
TITLE_HINTS = {
    "invoice": ("invoice", "bill", "receipt"),
    "contract": ("contract", "agreement", "legal"),
    "resume": ("resume", "cv", "curriculum"),
    "report": ("report", "analysis", "study"),
    "letter": ("letter", "correspondence"),
    "form": ("form", "application"),
}

#: What the structural features count.
FEATURE_AMOUNT = r"\$[\d,]+\.?\d*|\d+\.\d{2}"
FEATURE_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
FEATURE_BLANKS = r"_____+"
FEATURE_CHECKBOXES = r"\[\s*\]|\(\s*\)"

# --- Fixed values: stopwords -----------------------------------------------------------------------------------------

#: Words that are no keywords.
KEYWORD_STOPWORDS = tuple("""
    a about above after again against all am an and any are aren't as at be because been before being below between both
    but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further get
    got has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
    i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
    only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
    than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
    those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
    where where's which while who who's whom why why's will with won't would wouldn't you you'd you'll you're you've
    your yours yourself yourselves
""".split())

#: Words that don't count for similarity.
SIMILARITY_STOPWORDS = tuple("""
    a about above after again against all am an and any are as at be because been before being below between both but by
    can cannot could did do does doing don down during each few for from further get got has have having he her here
    hers herself him himself his how i if in into is it its itself let me more most my myself no nor not of off on once
    only or other our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which
    while who will with would you your yours yourself
""".split())

# --- Fixed values: text ----------------------------------------------------------------------------------------------

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "Rev",
    "e.g", "i.e", "etc", "vs", "fig", "no", "vol", "pp",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)

#: English function words.
ENGLISH_MARKERS = ("the", "and", "is", "in", "of", "to", "a", "that", "for", "it")

#: What typesetting leaves in extracted text, and its plain form.
PLAIN_FORMS = {
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\u2013": "-",
    "\u2014": "--",
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2022": "*",
    "\u00a0": " ",
    "\u00ad": "",
}

#: Misread signs and what they stand for.
MISREAD = ((r"\brn\b", "m"), (r"\|", "I"))

# --- Fixed values: entities ------------------------------------------------------------------------------------------

EMAIL = (r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b",)
URL = (r"\bhttps?://[^\s<>\"{}|\\^`\[\]]+|www\.[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}[^\s]*",)
DATE = (
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b",
    r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b",
    r"(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b",
    r"(?i)\b(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b",
    r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4})\b",
)
AMOUNT = (
    r"(\$\s*[\d,]+(?:\.\d{1,2})?)\b",
    r"\b(USD|EUR|GBP|CAD|AUD|JPY)\s*([\d,]+(?:\.\d{1,2})?)\b",
    r"\b([\d,]+(?:\.\d{1,2})?)\s*(USD|EUR|GBP|CAD|AUD|JPY)\b",
    r"(?:total|amount|subtotal|tax|price)\s*[:\s]\s*(\$?[\d,]+(?:\.\d{1,2})?)",
)
PHONE = (
    r"\((\d{3})\)\s*(\d{3})[.\-\s](\d{4})",
    r"\b(\d{3})[.\-](\d{3})[.\-](\d{4})\b",
    r"\+(\d{1,3})\s(\d{1,4})\s(\d{3,4})\s(\d{4})",
    r"\b1[-.\s](\d{3})[-.\s](\d{3})[-.\s](\d{4})\b",
)
ADDRESS = (r"(?i)\b\d+\s+[A-Za-z0-9\s,\.]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Lane|Ln|Road|Rd|Way|Court|Ct|Place|Pl|Suite|Ste|Floor|Fl)\b[^\n]*",)
#: Of these the first group is the entity.
REFERENCE_NUMBER = (
    r"(?i)(?:invoice|inv)[\s#\-]*:?\s*([A-Z0-9\-]{4,20})",
    r"(?i)(?:p\.?o\.?|purchase order)[\s#\-]*:?\s*([A-Z0-9\-]{4,20})",
    r"(?i)(?:ref(?:erence)?|case)[\s#\-]*:?\s*([A-Z0-9\-]{4,20})",
    r"(?i)(?:no\.|number|#)\s*([A-Z]?\d{4,12})",
)
PERSON = (r"\b((?:Mr|Mrs|Ms|Dr|Prof|Rev|Sir|Lady|Lord)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b",)
ORGANIZATION = (r"\b([A-Z][a-zA-Z&\s,\.]+(?:Inc\.|LLC|Ltd\.|Corp\.|Co\.|GmbH|PLC|LLP|LP|AG))\b",)

#: type, confidence, patterns, whether the first group is the entity; they are recognised in this order.
RECOGNISERS = (
    ("email", 0.99, EMAIL, False),
    ("url", 0.95, URL, False),
    ("date", 0.90, DATE, False),
    ("amount", 0.85, AMOUNT, False),
    ("phone", 0.80, PHONE, False),
    ("address", 0.70, ADDRESS, False),
    ("reference_number", 0.80, REFERENCE_NUMBER, True),
    ("person", 0.75, PERSON, False),
    ("organization", 0.70, ORGANIZATION, False),
)

#: phrases, type, role: the first rule with the entity's type and a phrase in the characters before it names the role.
ROLE_RULES = (
    (("invoice date", "date of invoice", "billed date"), "date", "invoice_date"),
    (("due date", "payment due", "due by"), "date", "due_date"),
    (("issue date", "issued on", "issued:"), "date", "issue_date"),
    (("date:", "as of", "dated"), "date", "document_date"),
    (("total", "amount due", "grand total", "balance due"), "amount", "invoice_total"),
    (("subtotal", "sub-total", "net amount"), "amount", "subtotal"),
    (("tax", "vat", "gst", "hst"), "amount", "tax_amount"),
    (("discount",), "amount", "discount_amount"),
    (("unit price", "unit cost", "rate"), "amount", "unit_price"),
    (("invoice number", "invoice no", "inv #", "invoice #"), "reference_number", "invoice_number"),
    (("purchase order", "po number", "p.o."), "reference_number", "po_number"),
    (("from:", "sender:", "signed by", "submitted by"), "person", "sender"),
    (("to:", "recipient:", "addressed to", "attention:"), "person", "recipient"),
    (("bill to", "billed to", "ship to"), "organization", "customer"),
    (("vendor", "supplier", "sold by", "from:"), "organization", "vendor"),
    (("effective date", "commencement date", "start date"), "date", "effective_date"),
    (("expiry date", "expiration date", "end date", "termination date"), "date", "expiry_date"),
    (("email:", "e-mail:", "contact:"), "email", "contact_email"),
    (("phone:", "tel:", "telephone:", "mobile:"), "phone", "contact_phone"),
    (("address:", "located at", "office:"), "address", "office_address"),
    (("website:", "web:", "url:"), "url", "website"),
    (("ref:", "reference:", "case number:"), "reference_number", "case_reference"),
    (("author:", "prepared by", "written by"), "person", "author"),
    (("organization:", "company:", "institution:"), "organization", "issuing_org"),
)

#: How many characters before an entity the rules see, and a line that is just a label.
ROLE_CONTEXT = 60
ROLE_LABEL = r"^([a-z][a-z\s]{1,30}):\s*$"

#: document type, field, roles, entity types
FIELDS = (
    ("invoice", "vendor", ("vendor",), ("organization", "person")),
    ("invoice", "customer", ("customer",), ("organization", "person")),
    ("invoice", "invoice_number", ("invoice_number",), ("reference_number",)),
    ("invoice", "invoice_date", ("invoice_date", "document_date"), ("date",)),
    ("invoice", "due_date", ("due_date",), ("date",)),
    ("invoice", "subtotal", ("subtotal",), ("amount",)),
    ("invoice", "tax", ("tax_amount",), ("amount",)),
    ("invoice", "total", ("invoice_total",), ("amount",)),
    ("invoice", "po_number", ("po_number",), ("reference_number",)),
    ("invoice", "contact_email", ("contact_email",), ("email",)),
    ("invoice", "contact_phone", ("contact_phone",), ("phone",)),
    ("contract", "party_a", ("sender",), ("organization", "person")),
    ("contract", "party_b", ("recipient",), ("organization", "person")),
    ("contract", "effective_date", ("effective_date",), ("date",)),
    ("contract", "expiry_date", ("expiry_date",), ("date",)),
    ("contract", "reference", ("case_reference",), ("reference_number",)),
    ("resume", "candidate_name", ("sender",), ("person",)),
    ("resume", "email", ("contact_email",), ("email",)),
    ("resume", "phone", ("contact_phone",), ("phone",)),
    ("resume", "address", ("office_address",), ("address",)),
    ("resume", "website", ("website",), ("url",)),
    ("report", "author", ("author",), ("person",)),
    ("report", "issuing_organization", ("issuing_org",), ("organization",)),
    ("report", "report_date", ("document_date",), ("date",)),
    ("report", "reference", ("case_reference",), ("reference_number",)),
    ("letter", "sender", ("sender",), ("person", "organization")),
    ("letter", "recipient", ("recipient",), ("person", "organization")),
    ("letter", "date", ("document_date",), ("date",)),
    ("letter", "subject", (), ()),
    ("form", "submitter", ("sender",), ("person",)),
    ("form", "date", ("document_date",), ("date",)),
    ("form", "reference", ("case_reference",), ("reference_number",)),
)

# --- Fixed values: layout --------------------------------------------------------------------------------------------

FOOTER = r"(?i)(page\s+\d+|\bpg\.\s*\d+|\d+\s*/\s*\d+|copyright|©|\bconfidential\b)"
BULLET = "^[\u2022\u2023\u25e6\u2043\u2219" + r"\-\*\+]\s+"
NUMBERED = r"^(\d+[\.\)]\s+|[a-zA-Z][\.\)]\s+)"
CAPTION = r"(?i)^(figure|fig\.|table|chart|diagram|image)\s*[\d:.]"
TITLE_SIZE, HEADER_SIZE, USUAL_SIZE = 16.0, 12.0, 11.0
HEADING_WORDS, CAPITAL_WORDS = 15, 8

# --- Fixed values: files ---------------------------------------------------------------------------------------------

#: A file's first bytes, and what they show.
MAGIC_BYTES = (
    (b"%PDF", "pdf"),
    (b"\x89PNG", "image"),
    (b"\xff\xd8\xff", "image"),
    (b"GIF87a", "image"),
    (b"GIF89a", "image"),
    (b"BM", "image"),
    (b"II*\x00", "image"),
    (b"MM\x00*", "image"),
    (b"RIFF", "image"),
)
SUFFIXES = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "bmp": "image", "webp": "image", "gif": "image"}
