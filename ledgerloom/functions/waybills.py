"""Fields, lane, times, confidence and flags of delivery notes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What no location is, and what one has a word of, from the surest to the least sure.
NO_PLACE = (
    r"validity", r"customer.*account", r"name.*address", r"terms.*conditions", r"binding.*shipper", r"consignment\s*note", r"issued\s*by", r"routing\s*and\s*destination", r"loading\s*point.*destination", r"customer.*name",
    r"cust\.\s*ref\s*#", r"^\s*:\s*$", r"^\s*[a-z]{2,3}\s*$", r"(?:copies|validity|originals)", r"^\d+$", r"^\d{4}-\d{5,8}[A-Z]{3}$", r"^\d{10}[A-Z]{3}$", r"^y?uae$", r"^\s*$", r"^[\s\W]+$", r"head\s*plate", r"trailer\s*plate",
    r"head\s*plate\s*\d+", r"trailer\s*plate\s*\d+", r"destination\s*code:\s*\d+", r"ft-sg", r"carrier\s*details", r"vehicle\s*(?:no|number)", r"head\s*plate.*?trailer\s*plate.*?destination\s*code",
)
PLACE_WORDS = {
    "high": ("mosb", "mirfa", "shuweihat", "khalifa", "mina zayed", "jebel ali", "mussafah", "kizad", "icad", "m44"),
    "medium": ("warehouse", "port", "yard", "site", "industrial", "free zone", "abu dhabi", "dubai", "ajman", "sharjah", "rak", "fujairah"),
    "low": ("dewa", "adnoc", "samsung", "dsv", "etihad", "agility", "masaood", "bergum", "sas", "power", "schenker", "schencker", "adopt", "hauler"),
}
OTHER_PLACE = r"\d+|road|street|zone|area|plot|building|warehouse|yard|site"
NOISE = (r"head\s*plate\s*\d+", r"trailer\s*plate\s*\d+", r"destination\s*code:\s*\d+", r"ft-sg", r"carrier\s*details.*", r"vehicle\s*(?:no|number):?\s*\d+")
# Fields and times with their patterns; the first group counts.
CODE, DAY, TIME = r"([A-Z0-9\-]+)", r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2})"
FIELDS = {
    "waybill_no": rf"(?:delivery\s*note/waybill\s*#|waybill\s*#)\s*[:#]?\s*{CODE}", "printed_date": rf"printed\s*date\s*[:#]?\s*{DAY}", "do_no": rf"\bdo\s*#\s*[:#]?\s*{CODE}", "do_validity": rf"do\s*validity\s*[:#]?\s*{DAY}",
    "cust_ref": rf"cust\.?\s*ref\.?\s*#\s*[:#]?\s*{CODE}", "bol_no": rf"\bbol\s*#\s*[:#]?\s*{CODE}", "order_no": rf"order\s*(?:number|no\.?)\s*[:#]?\s*{CODE}", "job_no": rf"job\s*(?:number|no\.?)\s*[:#]?\s*{CODE}",
    "po_no": rf"po\s*(?:number|no\.?)\s*[:#]?\s*{CODE}", "req_truck_type": r"req\.?\s*truck\s*type\s*[:#]?\s*([^\n]+)", "head_plate": rf"head\s*plate\s*[:#]?\s*{CODE}", "trailer_plate": rf"trailer\s*plate\s*[:#]?\s*{CODE}",
    "trailer_type": r"trailer\s*type\s*[:#]?\s*([^\n]+)", "driver_name": r"driver\s*name\s*[:#]?\s*([^\n]+)", "employee_id": r"employee\s*#\s*[:#]?\s*([0-9]+)", "trip_no": rf"trip\s*no\.?\s*[:#]?\s*{CODE}",
}
TIMES = {f"{name}_dt": rf"{said}\s+date/time\s*[:#]?\s*{TIME}" for name, said in (("arrive_loading", r"arrival\s+for\s+loading"), ("loading_started", r"loading\s+started"), ("loading_finish", r"loading\s+finish"), ("arrive_offloading", r"arrival\s+for\s+offloading"), ("offloading_started", r"offloading\s+started"), ("offloading_ended", r"offloading\s+ended"))}
ROUTING = r"routing\s+and\s+destination\s*[:\n]*(.*?)(?=head\s+plate|trailer\s+plate|carrier\s+details|consignment\s+information|$)"
LOADING = (r"loading\s+address\s*:\s*([^\n]+?)(?=\s*destination|$)", r"loading\s+point\s*:\s*([^\n]+?)(?=\s*destination|$)", r"from\s*:\s*([^\n]+?)(?=\s*to|$)")
DELIVERY = (r"destination\s*:\s*([^\n]+?)(?=\s*trip|order|job|$)", r"to\s*:\s*([^\n]+?)(?=\s*trip|order|job|$)")
TABLES = (r"loading\s*(?:point|address)\s*[\t|]+\s*destination\s*\n+\s*([^\t|\n]+)\s*[\t|]+\s*([^\t|\n]+)", r"([A-Z][^\n]{3,50}?(?:yard|port|site|warehouse)[^\n]*?)\s{3,}([A-Z][^\n]{3,50}?(?:yard|port|site|warehouse))")
FROM_TO = r"\bfrom\s*[:#]?\s*([A-Z][^,\n]{5,80}?)\s+to\s*[:#]?\s*([A-Z][^,\n]{5,80}?)(?=\s{2,}|\n|trip|order|$)"
LABELLED_LOADING = r"loading\s*(?:address|point)\s*[:#]\s*\n?\s*([A-Z][^\n]{5,100}?)(?=\s*\n|destination|trip)"
LABELLED_DELIVERY = r"(?<!routing and )(?<!name & )(?<!name and )destination\s*[:#]\s*\n?\s*([A-Z][^\n]{5,100}?)(?=\s*\n|trip|order|job|$)"
DIRECT_DELIVERY = r"Destination\s*[:#]\s*([A-Z][^\n]{3,80})"
SITES = (("MOSB_YARD", ("mosb",)), ("MOSB_YARD", ("mussafah",)), ("MIRFA_SITE", ("mirfa",)), ("SHUWEIHAT_SITE", ("shuweihat",)), ("KHALIFA_PORT", ("khalifa", "port")), ("MINA_ZAYED_PORT", ("mina", "zayed")), ("JEBEL_ALI_PORT", ("jebel", "ali")), ("DSV_WAREHOUSE", ("dsv", "warehouse")), ("DSV_WAREHOUSE", ("dsv", "yard")))
REQUIRED = ("waybill_no", "trip_no", "order_no", "po_no")


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9/#:._\- ]", " "), r"\s+", " "))


def valid_place(text: Column) -> Column:
    """Whether a text may be a location: 5 to 100 letters in plain form, nothing of NO_PLACE, and a word of PLACE_WORDS or OTHER_PLACE.
    Not null: no text is no location."""
    t = plain(text)
    words = "|".join(w for own in PLACE_WORDS.values() for w in own)
    none = "|".join(f"(?:{p})" for p in NO_PLACE)
    return F.coalesce(F.char_length(t).between(5, 100) & ~t.rlike(f"(?i){none}") & t.rlike(f"(?i){words}|{OTHER_PLACE}"), F.lit(False))


def first(text: Column, pattern: str, group: int = 1, flags: str = "(?ims)") -> Column:
    """A group of the first match, trimmed; null where nothing matches."""
    return F.nullif(F.trim(F.regexp_extract(text, flags + pattern, group)), F.lit(""))


def cleaned(place: Column) -> Column:
    """A loading place without plates, codes and vehicles; null below five letters."""
    out = place
    for p in NOISE:
        out = F.regexp_replace(out, f"(?i){p}", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.char_length(out) >= 5, out)


def if_valid(place: Column) -> Column:
    return F.when(valid_place(place), place)


def site(place: Column) -> Column:
    """The known site that a place names, else the place."""
    t, out = plain(place), None
    for name, words in SITES:
        fits = F.lit(True)
        for w in words:
            fits = fits & t.contains(w)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return F.when(place.isNotNull(), out.otherwise(place))


def is_waybill(text: Column) -> Column:
    t = plain(text)
    return t.contains("dsv") & (t.contains("delivery note") | t.contains("waybill")) & (t.contains("road freight") | t.contains("consignment") | t.contains("routing and destination"))


def fields(text: Column) -> dict[str, Column]:
    """Each of FIELDS and TIMES; order, job and purchase numbers only where they look like such."""
    out = {name: first(text, p) for name, p in (FIELDS | TIMES).items()}
    digits = lambda c: (F.char_length(c) >= 6) & c.rlike(r"\d") & ~c.rlike(r"(?i)^(?:job|po|loading|order)$")
    out["order_no"] = F.when(out["order_no"].rlike(r"(?i)^\d{2,}-[A-Z0-9]{3,}$"), out["order_no"])
    out["job_no"] = F.when(digits(out["job_no"]), out["job_no"])
    out["po_no"] = F.when(digits(out["po_no"]) & out["po_no"].contains("-"), out["po_no"])
    return out


def candidates(text: Column, section: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """(origins, destinations) as they stand in the routing section (r), in tables (t), in a sentence (s), under labels (l) and under a bare
    label (d)."""
    cut = lambda source, pattern, group=1: first(source, pattern, group, "(?i)")
    origins = {f"r{n}": cut(section, p) for n, p in enumerate(LOADING)} | {f"t{n}": cut(text, p) for n, p in enumerate(TABLES)} | {"s": cut(text, FROM_TO), "l": cut(text, LABELLED_LOADING)}
    labelled = cut(text, LABELLED_DELIVERY)
    labelled = F.when(~labelled.rlike("(?i)customer|account|address|name|number"), labelled)
    destinations = {f"r{n}": cut(section, p) for n, p in enumerate(DELIVERY)} | {f"t{n}": cut(text, p, 2) for n, p in enumerate(TABLES)}
    return origins, destinations | {"s": cut(text, FROM_TO, 2), "l": labelled, "d": first(text, DIRECT_DELIVERY)}
