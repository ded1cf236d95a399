"""Sources, cleansing and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import duck
from catalog.domain import load, sql
from catalog.registry import query
from costproof.functions import german, text, vendor
from costproof.operators import classify, cleansing
from costproof.sources import documents as src

_LINES = """
select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents
"""


@query("explode_lines", f"select doc_id, cast(line_no as int) as line_no, line from ({_LINES}) t")
def explode_lines(spark, d):
    return src.explode_lines(load(spark, d, "documents").select("doc_id", "text"))


@query("text_layer_status", """
select doc_id, sum(length(trim(line, ' ' || chr(9) || chr(10) || chr(13)))) < 20 as text_layer_empty from (""" + _LINES + """) t group by doc_id""")
def text_layer_status(spark, d):
    pages = src.explode_lines(load(spark, d, "documents").select("doc_id", "text"))
    return src.text_layer_status(pages.withColumnsRenamed({"line_no": "page_no", "line": "text"}))


@query("dedupe_by_content", """
select doc_id, sha256(text) as content_hash, min(doc_id) over (partition by text) as first_id,
  doc_id = min(doc_id) over (partition by text) as is_first, count(*) over (partition by text) as copies from documents""")
def dedupe_by_content(spark, d):
    return src.dedupe_by_content(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").drop("text")


@query("de_decimal", sql(rf"""
select invoice_id, pos_seq, cast(replace(replace(regexp_extract(t, '-?(?:\d{{1,3}}(?:\.\d{{3}})+|\d+)(?:,\d+)?'), '.', ''), ',', '.') as decimal(28,6)) as amount
from (select invoice_id, pos_seq, 'Betrag EUR ' || {duck.format_de('line_total_net')} || ' netto' as t from invoice_positions)""", "invoice_positions"))
def de_decimal(spark, d):
    printed = F.concat(F.lit("Betrag EUR "), german.format_de(F.col("line_total_net")), F.lit(" netto"))
    return load(spark, d, "invoice_positions").select("invoice_id", "pos_seq", german.de_decimal(printed).alias("amount"))


@query("money_token", sql(f"""
select invoice_id, pos_seq, line_total_net as amount from invoice_positions""", "invoice_positions"))
def money_token(spark, d):
    x = F.col("line_total_net")
    printed = F.when(F.col("pos_seq") % 2 == 0, german.format_de(x)).otherwise(F.format_number(x, 2))
    return load(spark, d, "invoice_positions").select(
        "invoice_id", "pos_seq", german.money_token(F.concat(printed, F.lit(" €"))).alias("amount"))


@query("de_date", sql("select invoice_id, invoice_date as parsed from invoices", "invoices"))
def de_date(spark, d):
    months = F.array(*[F.lit(m) for m in ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August",
                                          "September", "Oktober", "November", "Dezember")])
    day = F.col("invoice_date")
    named = F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.element_at(months, F.month(day)), F.lit(" "), F.year(day).cast("string"))
    printed = F.when(F.col("invoice_id") % 2 == 0, german.format_date(day)).otherwise(named)
    return load(spark, d, "invoices").select("invoice_id", german.de_date(F.concat(F.lit("Musterau, den "), printed)).alias("parsed"))


@query("clean_text", r"""
select doc_id, regexp_replace(nfc_normalize(text), '([\p{L}\p{N}_])-\n\s*([\p{L}\p{N}_])', '\1\2', 'g') as cleaned from documents""")
def clean_text(spark, d):
    return load(spark, d, "documents").select("doc_id", german.clean_text(F.col("text")).alias("cleaned"))


@query("format_de", sql(f"select invoice_id, pos_seq, {duck.format_de('line_total_net')} as printed from invoice_positions", "invoice_positions"))
def format_de(spark, d):
    return load(spark, d, "invoice_positions").select("invoice_id", "pos_seq", german.format_de(F.col("line_total_net")).alias("printed"))


@query("format_pages", """
select l_orderkey as id, case when n = 0 then '' when n = 1 then 'Seite ' || cast(ps[1] as varchar)
  else 'Seite ' || array_to_string(ps[1:n-1], ', ') || ' und ' || cast(ps[n] as varchar) end as citation
from (select l_orderkey, list_sort(list_distinct(list_filter([l_linenumber - 1, cast(l_quantity as int) % 9, l_linenumber - 1], lambda p: p > 0))) as ps, length(ps) as n from lineitem)""")
def format_pages(spark, d):
    pages = F.array(F.col("l_linenumber") - 1, F.col("l_quantity").cast("int") % 9, F.col("l_linenumber") - 1)
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), german.format_pages(pages).alias("citation"))


@query("truncate_name", r"""
select doc_id, case when length(t) <= 80 then t when strpos(cut, ' ') > 0 and length(cut) - strpos(reverse(cut), ' ') >= 40
   then regexp_replace(left(cut, length(cut) - strpos(reverse(cut), ' ')), '\s+$', '') || '…' else cut || '…' end as name
from (select doc_id, t, regexp_replace(left(t, 79), '\s+$', '') as cut from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents))""")
def truncate_name(spark, d):
    return load(spark, d, "documents").select("doc_id", text.truncate_name(F.col("text")).alias("name"))


@query("normalize_discounts", sql("""
select offer_id, case when preisnachlass is null and sonderpreis < 0 then -sonderpreis else abs(preisnachlass) end as preisnachlass,
  case when sonderpreis > 0 then sonderpreis end as sonderpreis from offers""", "offers"))
def normalize_discounts(spark, d):
    return cleansing.normalize_discounts(load(spark, d, "offers")).select("offer_id", "preisnachlass", "sonderpreis")


_INCL = r"optional and line_total_net = 0 and regexp_matches(description || ' ' || coalesce(optional_reason, ''), '(?i)\binkl(usive|\.)?\b')"


@query("unflag_inclusive", sql(f"""
select offer_id, pos_seq, optional and not coalesce({_INCL}, false) as optional,
  case when not coalesce({_INCL}, false) then optional_reason end as optional_reason from offer_positions""", "offer_positions"))
def unflag_inclusive(spark, d):
    return cleansing.unflag_inclusive(load(spark, d, "offer_positions")).select("offer_id", "pos_seq", "optional", "optional_reason")


NORM_OFFERS = """norm_offers as (select * replace (case when preisnachlass is null and sonderpreis < 0 then -sonderpreis else abs(preisnachlass) end as preisnachlass,
  case when sonderpreis > 0 then sonderpreis end as sonderpreis) from offers)"""


@query("drop_duplicate_discounts", sql(f"""
with {NORM_OFFERS}
select p.offer_id, p.pos_seq from offer_positions p join norm_offers o on p.offer_id = o.offer_id
where not coalesce(o.kind <> 'statement' and line_total_net < 0 and not regexp_matches(trim(pos), '^[0-9]')
  and regexp_matches(pos || ' ' || description, '(?i)rabatt|nachlass|skonto')
  and (coalesce(abs(-line_total_net - preisnachlass) <= 0.02, false) or coalesce(abs(-line_total_net - (nettosumme - sonderpreis)) <= 0.02, false)), false)""", "offers", "offer_positions"))
def drop_duplicate_discounts(spark, d):
    offers, positions = load(spark, d, "offers", "offer_positions")
    return cleansing.drop_duplicate_discounts(positions, cleansing.normalize_discounts(offers)).select("offer_id", "pos_seq")


@query("strip_placeholder_recipient", sql("""
select invoice_id, case when not contains(upper(recipient_name), '[KUNDE') then recipient_name end as recipient_name,
  case when not contains(upper(recipient_address), '[KUNDE') then recipient_address end as recipient_address from invoices""", "invoices"))
def strip_placeholder_recipient(spark, d):
    df = cleansing.strip_placeholder_recipient(load(spark, d, "invoices"), ["recipient_name", "recipient_address"])
    return df.select("invoice_id", "recipient_name", "recipient_address")


def hint_sql(name: str) -> str:
    """Vendor part of a generated file name (DuckDB)."""
    stem = rf"regexp_replace({name}, '(.)\.[^.]*$', '\1')"
    words = rf"list_transform(string_split_regex({stem}, '[-_]+'), lambda w: trim(w, ' .'))"
    stop = r"list_transform(ws, lambda w: w = '' or regexp_matches(w, '\d') or rtrim(lower(w), '.') in ('ar','sr','tr','az','rg','re','rechnung','rechn','nr','invoice'))"
    cut = f"(select case when coalesce(list_position({stop}, true), 0) > 0 then array_to_string(ws[1:list_position({stop}, true) - 1], ' ') else array_to_string(ws, ' ') end from (select {words} as ws))"
    return cut


@query("vendor_from_filename", sql(rf"""
select invoice_id, case when length(regexp_replace(n, '[^\p{{L}}]', '', 'g')) >= 3 then n end as vendor
from (select invoice_id, {hint_sql('source_name')} as n from invoices)""", "invoices"))
def vendor_from_filename(spark, d):
    return load(spark, d, "invoices").select("invoice_id", text.vendor_from_filename(F.col("source_name")).alias("vendor"))


@query("fix_vendor_is_recipient", sql(f"""
with named as (select i.*, case when invoice_id % 2 = 0 then client_name else vendor_name end as read_name, {hint_sql('source_name')} as hint, client_name
   from invoices i join projects p on i.project_id = p.project_id),
sets as (select *, {duck.vset('read_name')} as v, {duck.vset('recipient_name')} as r, {duck.vset('client_name')} as c, {duck.vset('hint')} as h from named),
flags as (select *, (list_has_any(v, r) or list_has_any(v, c)) and not (list_has_any(h, r) or list_has_any(h, c)) as swap from sets)
select invoice_id, case when swap then hint else read_name end as vendor_name, swap as vendor_from_filename from flags""", "invoices", "projects"))
def fix_vendor_is_recipient(spark, d):
    invoices, projects = load(spark, d, "invoices", "projects")
    clients = projects.select("project_id", "client_name")
    # Names are taken apart row by row: the rows are dealt out before, a file of few row groups is not left to few tasks.
    invoices = invoices.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "invoice_id")
    read = invoices.join(clients, "project_id").withColumn(
        "vendor_name", F.when(F.col("invoice_id") % 2 == 0, F.col("client_name")).otherwise(F.col("vendor_name"))).drop("client_name")
    # The derived file name always carries the true vendor, so half of the rows swap.
    return cleansing.fix_vendor_is_recipient(read, projects).select("invoice_id", "vendor_name", "vendor_from_filename")


@query("vendor_tokens", sql(f"""
select invoice_id, array_to_string({duck.tokens('vendor_name')}, ' ') as tokens, array_to_string({duck.tokens('vendor_name')}, '') as compact from invoices""", "invoices"))
def vendor_tokens(spark, d):
    return load(spark, d, "invoices").select("invoice_id", F.array_join(vendor.vendor_tokens(F.col("vendor_name")), " ").alias("tokens"),
                                             vendor.vendor_compact(F.col("vendor_name")).alias("compact"))


_LETTER = ("vendor_name || chr(10) || 'Industriestraße 12' || chr(10) || '54321 Musterau' || chr(10) || 'Rechnung: ' || invoice_number"
           " || chr(10) || " + duck.de_date("invoice_date") + " || ' bis 3. März 1999' || chr(10) || " + duck.format_de("abs(netto)") + " || ' €'")


def _letter():
    return F.concat_ws("\n", "vendor_name", F.lit("Industriestraße 12"), F.lit("54321 Musterau"),
                       F.concat(F.lit("Rechnung: "), F.col("invoice_number")),
                       F.concat(german.format_date(F.col("invoice_date")), F.lit(" bis 3. März 1999")),
                       F.concat(german.format_de(F.abs(F.col("netto"))), F.lit(" €")))


@query("extract_fields_regex", sql(rf"""
select invoice_id, array_to_string(regexp_extract_all(t, '\d{{2}}\.\d{{2}}\.\d{{4}}') || regexp_extract_all(t, '(?i)\d{{1,2}}\.\s?(?:januar|februar|märz|april|mai)\s?\d{{4}}'), ';') as dates,
  array_to_string(list_transform(regexp_extract_all(t, '(\d{{1,3}}(?:\.\d{{3}})*(?:,\d{{2}}))\s?€', 1), lambda a: replace(replace(a, '.', ''), ',', '.')), ';') as amounts,
  invoice_number, regexp_replace(vendor_name, '^.*[^\p{{L}}\p{{N}}_\s.]', '') || chr(10) || 'Industriestraße 12' || chr(10) || '54321 Musterau' || chr(10) || 'Rechnung' as address
from (select *, {_LETTER} as t from invoices)""", "invoices"))
def extract_fields_regex(spark, d):
    df = load(spark, d, "invoices").withColumn("f", text.extract_fields_regex(_letter()))
    return df.select("invoice_id", F.array_join("f.dates", ";").alias("dates"),
                     F.array_join(F.transform("f.amounts", lambda a: a.cast("string")), ";").alias("amounts"),
                     F.col("f.invoice_number").alias("invoice_number"), F.col("f.address").alias("address"))


EXPECTED = {"company": "Köhler", "address": "x", "date_range": ("1997-01-01", "1997-12-31"), "last_amount": "1000.00"}


@query("validate_fields", sql("""
select invoice_id, contains(vendor_name, 'Köhler') as company_valid, false as address_valid,
  invoice_date between date '1997-01-01' and date '1997-12-31' as date_range_valid, abs(netto) = 1000.00 as last_amount_valid, true as number_found from invoices""", "invoices"))
def validate_fields(spark, d):
    df = load(spark, d, "invoices").withColumn("text", _letter()).withColumn("fields", text.extract_fields_regex(F.col("text")))
    checked = cleansing.validate_fields(df, EXPECTED)
    return checked.select("invoice_id", "company_valid", "address_valid", "date_range_valid", "last_amount_valid", "number_found")


STOP_SQL = "('und','mit','für','fuer','der','die','das','inkl','inklusive','gemaess','gemäß','nach','aus','von','bis','je','pro','stk','stück','stueck','pauschal')"


def desc_sql(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex({duck.fold(f'lower({x})')}, '[^a-z0-9]+'), lambda w: length(w) > 2 and w not in {STOP_SQL})))"


def article_sql(x: str) -> str:
    """Article numbers: runs of letters and digits joined by . / -, holding a digit."""
    return rf"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '\b[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)+\b'), lambda w: lower(w)), lambda w: regexp_matches(w, '\d')))"


@query("article_numbers", sql(f"""
select invoice_id, pos_seq, array_to_string(list_sort({article_sql('description')}), ' ') as articles, array_to_string({desc_sql('description')}, ' ') as tokens from invoice_positions""", "invoice_positions"))
def article_numbers(spark, d):
    desc = F.col("description")
    return load(spark, d, "invoice_positions").select(
        "invoice_id", "pos_seq", F.array_join(F.array_sort(text.article_numbers(desc)), " ").alias("articles"),
        F.array_join(text.desc_tokens(desc), " ").alias("tokens"))


@query("invoice_number_key", sql(rf"""
select invoice_id, {duck.alnum('invoice_number')} as key, {duck.digits('invoice_number')} as digits, regexp_replace(lower(invoice_number), '\s+', '', 'g') as squeezed from invoice_scans""", "invoice_scans"))
def invoice_number_key(spark, d):
    n = F.col("invoice_number")
    return load(spark, d, "invoice_scans").select("invoice_id", text.invoice_number_key(n).alias("key"),
                                                  text.digits_only(n).alias("digits"), text.squeeze(n).alias("squeezed"))


def _rx(pattern: str) -> str:
    """A fixed pattern for RE2: Unicode flags dropped, the one lookahead written out."""
    return pattern.replace("(?iuU)", "(?i)").replace("^begpt(?!vn)\\d*_?", "^begpt($|[^v]|v$|v[^n])")


def class_sql() -> str:
    from costproof import fixed_values as fx

    def by_name(x: str) -> str:
        def m(p): return f"regexp_matches({x}, '{_rx(p)}')"
        return (f"case when {m(fx.ANTRAG_NAME)} then 'antragsbestaetigung' when {m(fx.BESCHEID_NAME)} then 'zuwendungsbescheid' when {m(fx.ZAHLUNG_NAME)} then 'zahlungsnachweis' "
                f"when {m(fx.OTHER_NAME)} and not {m(fx.INVOICE_NAME)} then 'other' when {m(fx.INVOICE_NAME)} then 'invoice' when {m(fx.OFFER_NAME)} then 'offer' end")

    def by_text(x: str) -> str:
        pairs = [(fx.ANTRAG_TEXT, "antragsbestaetigung"), (fx.BESCHEID_TEXT, "zuwendungsbescheid"), (fx.ZAHLUNG_TEXT, "zahlungsnachweis"),
                 (fx.INVOICE_TEXT, "invoice"), (fx.OTHER_TEXT, "other"), (fx.OFFER_TEXT, "offer")]
        return "case " + " ".join(f"when regexp_matches({x}, '{_rx(p)}') then '{c}'" for p, c in pairs) + " end"

    paid = f"regexp_matches(parent_name || ' ' || name, '{_rx(fx.ZAHLUNG_NAME)}')"
    return f"""classified as (select project_id, file_id, name, 
      case when img then case when {paid} then 'zahlungsnachweis' else 'other' end
           when n is not null then n when p in ('zahlungsnachweis', 'invoice') then p when t is not null then t else 'invoice' end as doc_class,
      case when img then case when {paid} then 'image in Zahlungsnachweis context' else 'image without payment-proof signal' end
           when n is not null then 'filename' when p in ('zahlungsnachweis', 'invoice') then 'parent folder name' when t is not null then 'first-page text'
           else 'undecided — defaulted to invoice for review' end as reason
    from (select *, regexp_matches(lower(name), '\\.(png|jpg|jpeg)$') as img, {by_name('name')} as n, {by_name('parent_name')} as p, {by_text('first_page_text')} as t from manifest)
    where regexp_matches(lower(name), '\\.(pdf|png|jpg|jpeg)$'))"""


@query("classify_documents", sql(f"with {class_sql()} select * from classified", "manifest"))
def classify_documents(spark, d):
    return classify.classify_files(load(spark, d, "manifest")).select("project_id", "file_id", "name", "doc_class", "reason")


@query("classify_images", sql(f"with {class_sql()} select file_id, doc_class, reason from classified where regexp_matches(name, '\\.png$')", "manifest"))
def classify_images(spark, d):
    images = load(spark, d, "manifest").where(classify.is_image(F.col("name")))
    return classify.classify_images(images).select("file_id", "doc_class", "reason")


@query("offer_kind", sql(r"""
select file_id, case when regexp_matches(name, '(?i)stellungnahme|eigenerkl|eigensch|kostensch|sch[äa]tzung|kostenannahme|kostenvoranschlag') then 'statement' else 'offer' end as kind from manifest""", "manifest"))
def offer_kind(spark, d):
    files = load(spark, d, "manifest").withColumn("doc_type", F.lit("offer"))
    return classify.offer_kind(files, "name").select("file_id", "kind")


@query("is_own_company", sql(r"select invoice_id, regexp_matches(vendor_name, '(?i)plan\s*wegweiser') as own from invoices", "invoices"))
def is_own_company(spark, d):
    return load(spark, d, "invoices").select("invoice_id", vendor.is_own_company(F.col("vendor_name")).alias("own"))


@query("label_trade_section", sql(r"""
select invoice_id, case when own then 'Energieberater' when pl and regexp_matches(t, '(?i)architekt|bauleit') then 'Architekt / Bauleiter' when pl then 'Fachplanung'
   when invoice_id % 3 <> 0 then 'Gewerk ' || cast(vid % 12 as varchar) end as trade, case when own or pl then 'baubegleitung' else 'massnahme' end as section
from (select *, regexp_matches(vendor_name, '(?i)plan\s*wegweiser') as own, regexp_matches(t, '(?i)energieberat|architekt|statik|sigeko|bauleit|fachplan|ingenieurbüro') as pl
  from (select *, vendor_name || ' ' || coalesce(subject, '') as t from invoices))""", "invoices"))
def label_trade_section(spark, d):
    invoices = load(spark, d, "invoices")
    return classify.label_trade_section(invoices, supplied_labels(invoices)).select("invoice_id", "trade", "section")


def supplied_labels(invoices):
    """Stands in for the label table an extraction step supplies."""
    trade = F.when(F.col("invoice_id") % 3 != 0, F.concat(F.lit("Gewerk "), (F.col("vid") % 12).cast("string")))
    return invoices.select("invoice_id", trade.alias("trade"), F.lit("massnahme").alias("section"))


@query("offer_inputs", sql(f"with {class_sql()} select file_id, name from classified where doc_class = 'offer' and regexp_matches(lower(name), '\\.pdf$')", "manifest"))
def offer_inputs(spark, d):
    return classify.offer_inputs(classify.classify_files(load(spark, d, "manifest"))).select("file_id", "name")


@query("ignored_documents", sql(f"""
with {class_sql()} select file_id, name, doc_class from classified where doc_class not in ('invoice', 'offer')
union all select file_id, name, 'unclassified' from manifest where file_id not in (select file_id from classified)""", "manifest"))
def ignored_documents(spark, d):
    manifest = load(spark, d, "manifest")
    ignored = classify.ignored_documents(manifest, classify.classify_files(manifest), ["invoice", "offer"])
    return ignored.select("file_id", "name", "doc_class")


@query("is_statement_block", sql("""
select project_id, block_seq, statement or regexp_matches(header, '(?i)sch[äa]tzung|stellungnahme|eigenerkl') as is_statement from vendor_blocks""", "vendor_blocks"))
def is_statement_block(spark, d):
    return load(spark, d, "vendor_blocks").select("project_id", "block_seq", classify.is_statement_block(F.col("header"), F.col("statement")).alias("is_statement"))


@query("is_deduction_line", sql("""
select invoice_id, pos_seq, -line_total_net < 0 and invoice_id % 3 = 0 as deduction from invoice_positions""", "invoice_positions"))
def is_deduction_line(spark, d):
    text_col = F.when(F.col("invoice_id") % 3 == 0, F.concat(F.lit("abzgl. Anzahlung "), "description")).otherwise(F.col("description"))
    return load(spark, d, "invoice_positions").select("invoice_id", "pos_seq", classify.is_deduction_line(-F.col("line_total_net"), text_col).alias("deduction"))


_SUFFIXES = ["pdf", "PdF", "JPg", "jpeg", "PNG", "txt", "pdf.bak"]
_STEMS = ["", "_", ".", "~", "a b "]


@query("manifest_from_paths", f"""
with f as (select doc_id, 's/' || source || '/' || {_STEMS}[doc_id % 5 + 1] || cast(doc_id as varchar) || '.' || {_SUFFIXES}[doc_id % 7 + 1] as path, n_chars as bytes from documents)
select path, split_part(path, '/', 2) as parent_name, split_part(path, '/', 3) as name, bytes from f
where doc_id % 5 not in (2, 3) and doc_id % 7 not in (5, 6)""")
def manifest_from_paths(spark, d):
    """Names with every kind of suffix case, underscores and hidden files."""
    key = F.col("doc_id")
    name = F.concat(F.lit("s/"), "source", F.lit("/"), F.get(F.array(*map(F.lit, _STEMS)), (key % 5).cast("int")), key.cast("string"), F.lit("."), F.get(F.array(*map(F.lit, _SUFFIXES)), (key % 7).cast("int")))
    listing = load(spark, d, "documents").select(name.alias("path"), F.col("n_chars").alias("bytes"), F.lit(None).cast("timestamp").alias("modified"))
    return src.manifest_from_paths(listing).drop("modified")
