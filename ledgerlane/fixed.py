"""Fixed values of the domain: lists, limits and accepted names."""

# --- bill rules -----------------------------------------------------------
CATEGORIES = ["Electronics", "Appliances", "Furniture", "Clothing", "Other"]
DEFAULT_CURRENCY = "INR"
DEFAULT_REMINDER_DAYS = [30, 7, 1]

TEXT_LIMITS = {
    "name": 160,
    "retailer": 160,
    "brand": 120,
    "invoice_number": 160,
    "serial_number": 160,
    "model_number": 160,
    "barcode": 160,
    "notes": 4000,
}
MAX_MONTHS = 1200
MAX_RETURN_DAYS = 3650
MAX_REMINDER_DAY = 365
MAX_REMINDERS = 10
ENDING_DAYS = 30
URGENT_RETURN_DAYS = 7

# --- originals ------------------------------------------------------------
MAX_FILE_BYTES = 15 * 1024 * 1024
MAX_PAGES = 10
FILE_TYPES = ["image/jpeg", "image/png", "image/webp", "application/pdf"]

# --- currency symbols of the English (India) number format -----------------
CURRENCY_SYMBOLS = {
    "INR": "₹",
    "USD": "$",
    "EUR": "€",
    "GBP": "£",
    "AUD": "A$",
    "CAD": "CA$",
}

# --- queues ---------------------------------------------------------------
UPLOADS_PER_DAY = 30
ASSISTANT_PER_DAY = 40
ASSISTANT_GAP_SECONDS = 3
QUEUE_BATCH = 50
DELIVERY_LEASE_SECONDS = 90
DELIVERY_WINDOW_HOURS = 23
DELIVERY_ATTEMPTS = 5
PAGE_ATTEMPTS = 3
EXTRACTION_ATTEMPTS = 3
CALLS_PER_RUN = 2
CLAIM_STALE_SECONDS = 120
JOB_GENERATIONS = 3
AUTOSAVE_QUIET_MS = 600

# --- extraction -----------------------------------------------------------
EXTRACTION_VERSION = 5
FIELD_ISSUES = ["missing", "absent", "ambiguous", "unreadable", "rejected"]

#: bill fields as they are named in suggestion payloads -> column names
FIELDS = {
    "name": "name",
    "retailer": "retailer",
    "brand": "brand",
    "invoiceNumber": "invoice_number",
    "serialNumber": "serial_number",
    "modelNumber": "model_number",
    "barcode": "barcode",
    "category": "category",
    "purchasePrice": "purchase_price",
    "currency": "currency",
    "purchaseDate": "purchase_date",
    "warrantyMonths": "warranty_months",
    "warrantyExpiresAt": "warranty_expires_at",
    "returnWindowDays": "return_window_days",
    "returnExpiresAt": "return_expires_at",
    "notes": "notes",
}

# --- printed labels (fixed patterns, in the order they are defined) ---------
# role, priority, pattern.  Role "other" delimits neighbouring cells.
ROLE_LABELS = [
    ("purchasePrice", 4, r"(?:grand\s+total|net\s+payable|total\s+payable|invoice\s+(?:total|value)|bill\s+total|total\s+[aà]\s+payer)"),
    ("purchasePrice", 3, r"(?:total\s+amount(?:\s+paid)?|amount\s+paid|net\s+amount|pay[ée])"),
    ("purchasePrice", 1, r"(?:total|amount\s+due)"),
    ("other", 1, r"(?:(?:total\s+)?(?:change|kembali(?:an)?)|cash(?:\s+(?:tendered|received|payment|amount))?|tunai|tendered|(?:credit|debit)\s+card|card\s+(?:paid|payment|amount)|visa|mastercard|upi|deposit|advance|outstanding|balance(?:\s+due)?|total\s+(?:items?|quantity|qty))"),
    ("other", 1, r"(?:sub\s*total|mrp|list\s+price|unit\s+price|rate|discount|tax(?:able\s+(?:amount|value))?|[sic]gst|cess|balance|quantity|qty|hsn|sac)"),
    ("purchaseDate", 2, r"(?:purchase\s+date|date\s+of\s+purchase|invoice\s+date|bill\s+date|receipt\s+date)"),
    ("other", 1, r"(?:(?:delivery|dispatch|shipping|shipped|order|due|payment|manufactur(?:e|ed|ing)|mfg\.?|expiry|expiration)\s+date|date\s+(?:of\s+(?:order|manufactur(?:e|ing)|birth)|due)|birth\s+date|dob)"),
    ("warrantyExpiresAt", 1, r"warranty\s+(?:expires(?:\s+at)?|end(?:\s+date)?|expiry(?:\s+date)?)"),
    ("returnExpiresAt", 1, r"return\s+(?:by|deadline|expiry(?:\s+date)?|end\s+date)"),
    ("purchaseDate", 1, r"date"),
    ("invoiceNumber", 1, r"(?:invoice|receipt|bill)(?:\s*(?:no\.?|number|id))?|bill\s+of\s+supply\s+number"),
    ("serialNumber", 1, r"(?:serial(?:\s*(?:number|no\.?))?|s/n|imei(?:\s*[12])?)"),
    ("modelNumber", 1, r"model(?:\s*(?:name|number|no\.?))?"),
    ("barcode", 1, r"(?:barcode|ean|upc|gtin)"),
    ("other", 1, r"(?:order(?:\s*(?:number|no\.?|id))?|gst(?:in|\s*(?:number|no\.?))?|pan|sku|customer\s+id|reference(?:\s*(?:number|no\.?|id))?)"),
    ("brand", 2, r"brand(?:\s+name)?"),
    ("brand", 1, r"(?:manufacturer(?:\s+name)?|manufactured\s+by|mfr)"),
    ("retailer", 1, r"(?:retailer|store|seller|merchant|sold\s+by)"),
    ("other", 1, r"(?:buyer|customer|bill(?:ed)?\s+to|ship(?:ped)?\s+to)"),
    ("warrantyMonths", 1, r"warranty(?:\s+(?:period|duration))?"),
    ("returnWindowDays", 1, r"return\s+(?:window|period)"),
]

# field, priority, pattern of the label-only reader.  An empty field delimits.
FIELD_LABELS = [
    ("name", 1, r"item name|product name|bill name|product description|item description"),
    ("retailer", 1, r"retailer|store|seller|sold by|merchant"),
    ("brand", 2, r"brand(?: name)?"),
    ("brand", 1, r"manufacturer(?: name)?|manufactured by"),
    ("invoiceNumber", 1, r"(?:tax )?invoice (?:no\.?|number)|bill (?:no\.?|number)|receipt (?:no\.?|number)|bill of supply (?:no\.?|number)"),
    ("serialNumber", 1, r"serial (?:no\.?|number)|s/n|imei(?: ?[12])?"),
    ("modelNumber", 1, r"model (?:no\.?|number)|model"),
    ("barcode", 1, r"barcode|ean|upc|gtin"),
    ("purchaseDate", 4, r"purchase date|date of purchase"),
    ("purchaseDate", 3, r"invoice date|bill date|receipt date"),
    ("purchaseDate", 1, r"date"),
    ("purchasePrice", 5, r"grand total|final total"),
    ("purchasePrice", 4, r"total amount(?: paid)?|net payable|total payable"),
    ("purchasePrice", 3, r"amount paid"),
    ("purchasePrice", 2, r"amount due"),
    ("purchasePrice", 1, r"total"),
    ("warrantyMonths", 1, r"warranty(?: period| duration)?"),
    ("returnWindowDays", 1, r"return (?:window|period)"),
    ("warrantyExpiresAt", 1, r"warranty expires|warranty end date|warranty expiry"),
    ("returnExpiresAt", 1, r"return by|return deadline"),
    ("", 0, r"(?:customer|buyer|recipient)(?: name)?|bill(?:ing)? to|ship(?:ping)? to|order (?:date|id|no\.?|number)|date of order|due date|date due|payment date|delivery date|shipping date|manufactur(?:e|ed|ing) date|expiry date|subtotal|sub total|discount|qty|quantity|hsn|sac|unit price|rate|cgst|sgst|igst|cess|tax|payment method"),
]

# Which money row a tender label stands for.
TENDER_LABELS = [
    ("change", r"\A(?:total\s+)?(?:change|kembali(?:an)?)\b"),
    ("cash", r"\A(?:cash|tunai|tendered)\b"),
    ("otherTender", r"\A(?:(?:credit|debit)\s+card|card|visa|mastercard|upi|deposit|advance|outstanding|balance)\b"),
]
ITEM_COUNT_PREFIX = r"\A\s*\d+\s+(?:articles?|article\(s\)|items?|item\(s\))\s*\z"
ITEM_COUNT = r"\(?\s*\d+(?:[.,]\d+)?\s*(?:items?|pcs?|pieces?)\s*\)?"

# Currency words and marks around an amount.
AMOUNT_CODES = "INR|USD|EUR|GBP|IDR|MYR|SGD|AUD|CAD|AED"
CURRENCY_ALIASES = {
    "INR": r"\bINR\b|\bRs\.?\b|₹",
    "USD": r"\bUSD\b|US\$",
    "EUR": r"\bEUR\b|€",
    "GBP": r"\bGBP\b|£",
    "IDR": r"\bIDR\b|\bRp\.?(?=\s|\d|\z)",
}
# Capital letters of which a text in plain ASCII has some wherever a pattern above matches.
CURRENCY_STEMS = {"INR": ["INR", "RS"], "USD": ["USD", "US$"], "EUR": ["EUR"], "GBP": ["GBP"], "IDR": ["IDR", "RP"]}
PRINTED_CODES = ["INR", "USD", "EUR", "GBP", "AUD", "CAD", "AED", "IDR", "MYR", "SGD"]
EURO_CUE = r"\bEUR\b|€"
DOT_DECIMAL_CUE = r"\b(?:USD|INR|GBP|MYR|SGD|AUD|CAD|AED)\b|[₹$£]"
DOT_GROUP_CUE = r"\b(?:IDR|EUR|Rp\.?|rupiah|tunai|kembali(?:an)?)\b|€"
# Capital letters of which a text in plain ASCII has some wherever a cue above matches.
CUE_STEMS = {
    "euro": ["EUR"], "dot_decimal": ["USD", "INR", "GBP", "MYR", "SGD", "AUD", "CAD", "AED", "$"],
    "dot_group": ["IDR", "EUR", "RP", "RUPIAH", "TUNAI", "KEMBALI"],
}

# Dates.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DATE_TOKEN = (
    r"(?<![\p{L}\p{N}])(?:\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})"
    r"|\d{1,2}(?:st|nd|rd|th)?[ /-]+[A-Za-z]+[ /-]+(?:\d{4}|\d{2})|[A-Za-z]+\s+\d{1,2},?\s+\d{4})(?![\p{L}\p{N}])"
)
NOT_A_SALE_DATE = r"https?:|www\.|\b(?:birth|dob|order|delivery|shipping|due|expir|manufactur)"
SALE_TIME = r"\A(?:[01]?\d|2[0-3])(?::[0-5]\d(?::[0-5]\d)?|h[0-5]\d)(?:\s*[ap]m)?\z"
TERMINAL_REFERENCES = r"\A\d{1,12}(?:[ \t]+\d{1,12}){0,3}\z"

# Names and identifiers.
PLACEHOLDERS = r"\A(?:unknown|n/?a|none|not\s+(?:found|available)|unreadable|illegible)\z"
NAME_PLACEHOLDERS = r"\b(?:unreadable|illegible|not readable)\b|\A(?:unknown|n/?a|none|not found|product description|item description)\z"
NAME_HEADER = r"\b(?:qty|quantity)\b.*\b(?:total|amount|price|discount)\b"
VALUE_HEADER = r"\A(?:qty|quantity|hsn|sac)\b.*\b(?:total|amount|price|discount|tax)\b"
PARTY_LINE = r"\A\s*(?:retailer|store|seller|merchant|sold by|buyer|customer)\s*[:#-]\s*(.+)\z"
COMPATIBLE_WITH = r"\b(?:for|compatible\s+with|fits|suitable\s+for|designed\s+for|works\s+with|replacement\s+for|use\s+with)\b"
INVOICE_ID = r"\b(?:invoice\s*(?:no\.?|number)|bill of supply number)\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]{5,})"
SERIAL_LABEL = r"\b(?:serial\s*(?:number|no\.?)|s/n|imei(?:\s*[12])?)\s*[:#]?"
PRODUCT_HEADER = r"\b(?:product|item)\s*(?:description|name)|\bdescription\b"
DURATION = r"\b(\d+)\s*(months?|years?|days?)\b"

