"""Table schemas, granularities, number kinds and reason codes."""

from __future__ import annotations

UNKNOWN, PREF, CITY, MACHIAZA, BLOCK, RSDT, PARCEL = range(7)
GRANULARITIES = ("unknown", "pref", "city", "machiaza", "block", "rsdt", "parcel")
LABELS = ("不明", "都道府県", "市区町村", "町字", "街区", "住居番号", "地番")
#: Kinds of numbers; a kind's granularity is three more.
KIND_BLOCK, KIND_RSDT, KIND_PARCEL = 1, 2, 3

PREF_TABLE = "lg_code int, pref string, lat double, lon double"
CITY_TABLE = "lg_code int, pref string, county string, city string, ward string, lat double, lon double"
NAMES = "pref string, county string, city string, ward string, oaza_cho string, chome string, chome_number string, koaza string"
TOWN_ROWS = f"ord bigint, lg_code int, machiaza_id int, rsdt_addr_flg int, {NAMES}, lat double, lon double"
TOWN_TABLE = (
    "row_id int, lg_code int, machiaza_id int, pref string, county string, city string, ward string, oaza_cho string, "
    "chome string, koaza string, rsdt_addr_flg int, lat double, lon double, source string, alt_machiaza array<int>"
)
HEAD_TABLE = "head string, place int"
KEY_TABLE = "place int, tail string, row_id int"
NUMBER_TABLE = "lg_code int, machiaza_id int, kind int, num1 int, num2 int, num3 int, lat double, lon double"
LEDGER = "url string, kind string, last_modified string, rows bigint, ingested_at string"
META = "key string, value string"

REGISTRY, SUPPLEMENT = "registry", "supplement"

#: Reason codes and the text that reports show for them; {0}, {1}, ... are parameters.
NOTES = {
    "MODEL_NOT_CONFIGURED": "no decision model: the first candidate was taken",
    "MODEL_FAILED": "the decision model did not answer, the first candidate was taken: {0}",
    "NARROW_EMPTY": "the candidates could not be narrowed",
    "SAME_NAME": "{0} towns share this name; the point is that of the first",
    "LOW_CONFIDENCE": "low confidence in the {0} ({1}); best guess: {2}",
    "NUMBER_NOT_FOUND": "the number is not among the candidates",
    "BRANCH_UNKNOWN": "the input has no branch number; the point is that of the first of {0}",
    "UNDETERMINED": "the {0} cannot be determined",
    "NO_CANDIDATE": "no candidate was found",
}
