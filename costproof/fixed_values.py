"""Word lists, patterns, limits and formats that results depend on.

Patterns are Java regular expressions; (?iu) makes case-insensitivity Unicode-aware and
(?U) does the same for \\w, \\b, \\d and \\s.
"""

# German and English month names.
MONTHS_DE = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august",
             "september", "oktober", "november", "dezember"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august",
             "september", "october", "november", "december"]
MONTH_SPELLINGS = {**{m: i for i, m in enumerate(MONTHS_DE, start=1)}, "maerz": 3}

# Number and date tokens.
DE_DECIMAL = r"-?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?"
MONEY_BODY = r"-?(?:\d{1,3}(?:\.\d{3})*,\d{2}|\d{1,3}(?:,\d{3})*\.\d{2})"
MONEY = rf"(?<![\d.,])({MONEY_BODY})(?![\d.,])"
MONEY_EUR = MONEY + r"\s*€"
PERCENT = MONEY + r"\s*%"

# Company names.
LEGAL_FORMS = r"(?iuU)\b(gmbh|mbh|ag|kg|ug|ohg|co|cokg|se|e\.?k\.?|inc|ltd|haftungsbeschränkt)\b\.?"
NAME_NOISE = r"(?iuU)[&+./,()\-–]|\bund\b|\b\d+\b"
GLUED_LEGAL_SUFFIXES = ["gmbh", "mbh", "cokg", "co", "kg", "ug", "ohg"]
# The reader's own consultancy: an invented name, to be set through own_pattern.
OWN_COMPANY = r"(?iuU)plan\s*wegweiser"
TRAILING_LEGAL_FORM = (
    r"(?iuU)\s*(gmbh\s*&\s*co\.?\s*kg|gmbh\s*&\s*cie\.?\s*kg|se\s*&\s*co\.?\s*kg|gmbh|ag|kg|ug"
    r"|e\.\s*k\.|ohg|gbr|mbh)\s*$"
)
LEGAL_TAIL = (r"(?:[\s,.]*(?:gmbh\s*&\s*co\.?\s*kg|gmbh\s*&\s*cie\.?\s*kg|se\s*&\s*co\.?\s*kg"
              r"|gmbh|ag|kg|ug|e\.\s*k\.|ohg|gbr|mbh)\b)?")
MASK_RESIDUE = r"(?U)\[KUNDE\]\s*(GmbH\s*&\s*Co\.?\s*KG|GmbH|AG|KG|UG|e\.\s*K\.|OHG|GbR|mbH)"

# Lines of a recipient block in an approval letter.
RECIPIENT_COMPANY = r"^.{4,80}?(?:GmbH\s*&\s*Co\.?\s*KG|GmbH|AG|KG|UG|e\.K\.|OHG|GbR|mbH)\s*$"
RECIPIENT_STREET = r"^.{3,60}\d.{0,12}$"
RECIPIENT_NO_STREET = r"\bDATUM\b|\d{1,2}\.\d{1,2}\.\d{4}"
RECIPIENT_PLACE = r"^\d{5}\s+.{2,40}"
FILENAME_TYPE_MARKERS = ["ar", "sr", "tr", "az", "rg", "re", "rechnung", "rechn", "nr", "invoice"]

# Position matching.
ARTICLE_NUMBER = r"(?U)\b(?=[A-Za-z0-9./-]*\d)[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)+\b"
DESCRIPTION_STOPWORDS = ["und", "mit", "für", "fuer", "der", "die", "das", "inkl", "inklusive",
                         "gemaess", "gemäß", "nach", "aus", "von", "bis", "je", "pro", "stk",
                         "stück", "stueck", "pauschal"]
WEIGHT_ARTICLE, WEIGHT_DESCRIPTION, WEIGHT_PRICE, WEIGHT_QTY = "0.35", "0.30", "0.25", "0.10"
HIGH_THRESHOLD, MEDIUM_THRESHOLD = "0.55", "0.40"
CLEAN_FRACTIONS = ["0.5", "0.333333333333", "0.25", "0.3", "0.4", "0.2", "0.1", "0.9", "0.8", "0.7"]
SECOND_SOURCE_FLOOR = 0.55
DEDUCTION_LINE = r"(?iuU)anzahlung|abschlag|akonto|abzgl|abz\.|bereits\s+(berechnet|gezahlt|in\s+rechnung)|teilrechnung"

# Tolerances.
CENT_TOLERANCE = "0.02"
VAT_TOLERANCE = "0.05"
SKONTO_TOLERANCE = "0.05"
RATIO_AGREEMENT = "0.002"
MIN_TEXT_CHARS = 20
MAX_DESCRIPTION = 80

# Document classes by file name, folder and first page.
ANTRAG_NAME = (r"(?iuU)antragsbest|f[öo]rderantrag|bza[\s_-]|bestätigung\s+zum\s+antrag"
               r"|^tpb\d*_|^begpt(?!vn)\d*_?")
BESCHEID_NAME = (r"(?iuU)zuwendungsbescheid|zusageschreiben|festsetzungsbescheid|auszahlungsbescheid"
                 r"|änderungsbescheid|aenderungsbescheid|\bbescheid\b|bescheid[\s_.-]")
ZAHLUNG_NAME = r"(?iuU)zahlungsnachweis|kontoauszug|überweisung|ueberweisung|zahlungsbeleg|umsatz"
OTHER_NAME = (r"(?iuU)kostenaufstellung|kostenzusammenstellung|vne[-_ ]?tabelle|fragenkatalog"
              r"|standortbeschreibung|standort"
              r"|vertrag|erkl[äa]rung|leasing|vollmacht|beauftragung"
              r"|zahlplan|nachweis|b[üu]rgschaft|\bauftrag|^auf[\s_.-]|bestellung|lieferschein"
              r"|best[äa]tigung"
              r"|verwendungsnachweis|vdz|jaz|heizlast|stundenzettel|kaufbeleg"
              r"|bestätigung\s+nach\s+durchführung"
              r"|^eewvn_|^qstvn_|^begptvn|^tpn\d*_"
              r"|^fue[\s_.-]|fachunternehmer")
INVOICE_NAME = (r"(?iuU)\brg[\s_.-]|^rg|rechnung|\brech\.|gutschrift|\bre[-_]\d|abschlag|schlussrechnung|anzahlung"
                r"|^\d*\.?\s*a[rz][\s_.-]|storno")
OFFER_NAME = (r"(?iuU)angebot|^ang[-_ ]?\d|\ban[-_]?\d|[-_ ]soll|stellungnahme|sch[äa]tzung"
              r"|kostenvoranschlag|eigenerkl")
ANTRAG_TEXT = r"(?iuU)bestätigung\s+zum\s+antrag|bza-id|antragsbestätigung|förderantrag|vorgangsnummer"
BESCHEID_TEXT = r"(?iuU)zuwendungsbescheid|zusageschreiben|festsetzungsbescheid|bewilligung"
ZAHLUNG_TEXT = r"(?iuU)kontoauszug|zahlungsavis|überweisungsauftrag|ausgeführte\s+überweisung"
INVOICE_TEXT = (r"(?iuU)\brechnung\b|\bgutschrift\b|rechnungs?-?\s*(nr|nummer)|belegnummer"
                r"|anzahlungsrechnung|abschlagsrechnung|teilrechnung|schlussrechnung")
OFFER_TEXT = r"(?iuU)\bangebot\b|angebots?-?\s*(nr|nummer)|\boffer\b|kostenvoranschlag"
OTHER_TEXT = r"(?iuU)leasingvertrag|kaufvertrag|auftragsbestätigung|fachunternehmererklärung"
STATEMENT_FILENAME = r"(?iuU)stellungnahme|eigenerkl|eigensch|kostensch|sch[äa]tzung|kostenannahme|kostenvoranschlag"
STATEMENT_BLOCK = r"(?iuU)sch[äa]tzung|stellungnahme|eigenerkl"
PLANNER = r"(?iuU)energieberat|architekt|statik|sigeko|bauleit|fachplan|ingenieurbüro"
ARCHITECT = r"(?iuU)architekt|bauleit"
INCLUSIVE_MARK = r"(?iuU)\binkl(usive|\.)?\b"
DISCOUNT_LABEL = r"(?iuU)rabatt|nachlass|skonto"
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg"]

# Layout lines of a printed cost sheet.
BLOCK_HEADER = (r"(?iuU)(\b(SOLL|NEU)\b.*(Angebot|vom|Sch[äa]tzung|Nebenkosten|Nebenosten))"
                r"|(Sch[äa]tzung|Stellungnahme)")
SUM_LINE = r"(?iuU)Gesamtpreis|Summe|Angebotspreis|Nettosumme|Gesamtsumme|Endbetrag"
SPECIAL_PRICE_LINE = r"(?iuU)Sonderpreis|Sonderkonditionen|Pauschalpreis"
NUMBERED_LINE = r"(?U)^\s*\d+[.\d]*\s+\S"
POSITION_LINE = r"(?U)^\s{0,4}(\d+(?:[.\-–]\d+)*)\s+(\S.*)$"
SKIPPED_LINE = r"(?U)^\s*(Position\s+Beschreibung|Σ|Sonderpreis|Nettosumme lt\.|Kostenaufstellung\s*$)|\d+,\d{2}\s*%"
VENDOR_BEFORE_OFFER = (r"(?iuU)^(?:SOLL|NEU)\s*:?\s*(?:SCHÄTZUNG\s+lt\.\s+Stellungnahme\s+)?(.+?)"
                       r"\s+(?:Angebot|Stellungnahme|vom\b)")
VENDOR_AFTER_DATE = r"(?iuU)vom\s+\d{1,2}\.\d{1,2}\.\d{2,4}[,;]?\s+(?:Fa\.\s*)?([^,;]+)"

# Evidence statuses and their German names.
STATUS_DE = {
    "verified": "belegt",
    "value-not-in-quote": "Wert nicht im Zitat",
    "quote-not-found": "Zitat nicht im Text",
    "unquoted": "ohne Zitat",
    "absent": "nicht angegeben",
    "unverifiable-scan": "Scan — nicht prüfbar",
    "xml": "E-Rechnung (XML)",
    "unresolved": "unbestätigt",
    "from-filename": "aus Dateiname",
}
DOUBTFUL = ["value-not-in-quote", "quote-not-found", "unquoted", "unresolved"]
EVIDENCE_FIELDS = ["vendor_name", "invoice_number", "invoice_date", "order_date", "netto", "brutto"]

# Invoice types that count as advances; e-invoice document type codes.
ADVANCE_TYPES = ["anzahlung", "teilrechnung"]
CHAIN_TYPES = ["anzahlung", "teilrechnung", "gutschrift"]
TYPE_CODES = {"380": "rechnung", "381": "gutschrift", "384": "rechnung", "326": "teilrechnung", "389": "rechnung"}

# Sites.
SUBPAGE_HINTS = ["ueber-uns", "uber-uns", "über-uns", "ueberuns", "about", "unternehmen",
                 "profil", "company", "produkte", "produkt", "leistungen", "leistung",
                 "verfahren", "technologie", "fertigung", "produktion", "service"]
LOCALE_PATHS = ["/de/", "/de", "/en/", "/en"]
MIN_PAGE_CHARS = 50
SHIFT_HOURS = {1: ("08:00", "16:00"), 2: ("08:00", "24:00"), 3: ("08:00", "08:00")}
EARTH_RADIUS_KM = 6371.0

# Login throttling and run history.
MAX_ATTEMPTS, WINDOW_SECONDS, LOCKOUT_SECONDS = 5, 300, 900
LIVE_LOG_LIMIT, LIVE_LOG_DROP, RETAIN_RUNS = 500, 100, 100

# What file names keep of a field. Patterns and their replacements, in order.
FILE_NAME_RULES = [(r'[\\/:*?"<>|\x00-\x1f]', "-"), (r"(?U)\s+", " ")]
FILE_NAME_EDGE, FILE_NAME_PART = " .-_", 60
FILE_VENDOR_RULES = [(LEGAL_FORMS, " "), (r"(?U)(?<!\w)(\w)\s*&\s*(\w)(?!\w)", "$1&$2"), (r"(?U)\s*&[\s.]*$", " "), (r"(?U)\s*&\s*\.", " ")]
FILE_NUMBER_RULES = [(r"(?U)\s+", "")]

# Sizes of companies as a stated size begins, and the word for them.
SIZE_WORDS = {"klein": "kleines", "mittel": "mittleres", "mittler": "mittleres", "groß": "großes", "gross": "großes"}

# Letters and their other spelling in names; what may stand between the words of a name.
SPELLINGS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "ae", "Ö": "oe", "Ü": "ue", "ß": "ss"}
NAME_SEPARATORS = r"[\s\-–,.]"
