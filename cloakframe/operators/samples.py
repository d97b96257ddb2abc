"""Annotated samples and records made from rows of an input table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.arrays import let
from ..functions.choice import hash_number, pick_index

# Word lists and templates of our own; the values fit the catalogue's patterns.
FIRST_NAMES = ("Ada", "Bo", "Clara", "Dmitri", "Elif", "Farah", "Gustav", "Hana", "Ivo", "Joana", "Kofi", "Lena")
LAST_NAMES = ("Abel", "Brandt", "Castro", "Duarte", "Eriksen", "Fontaine", "Grau", "Haas", "Ito", "Jansen", "Kaya")
COMPANIES = ("Northwind Freight", "Alder Clinic", "Blue Quarry", "Cobalt Mills", "Dune Labs", "Ember Foods")
STREETS = ("Oak Street", "Harbor Road", "Mill Lane", "Station Avenue", "Garden Row")
CITIES = ("Oslo", "Porto", "Lyon", "Graz", "Leeds", "Utrecht")

SAMPLE_TEMPLATES: tuple[str, ...] = (
    "{name} called about the open order.",
    "The visit of {name} to {company} went well.",
    "Send the papers to {address} before noon.",
    "Write to {email} or call {phone_number}.",
    "SSN of the applicant: {ssn}",
    "Charged to {credit_card_number} as agreed.",
    "{name} was born on {dob} in {address}.",
    "Driver license {license} was shown.",
    "Passport {passport} expires soon.",
    "Login from {ip_address} by {username} was refused.",
    "Chart {mrn} belongs to {name}.",
    "Refund to account {bank_account} is pending.",
    "VIN {vin} is registered to {company}.",
    "Rotate the key {api_key} today.",
    "Device {mac_address} left the network.",
    "Badge of {emp_id} issued to {name}.",
    "Claim under {insurance} for {name} at {company}.",
    "{company} moved to {address}; contact {email}.",
    "The weather stayed dry all week.",
    "Minutes of the meeting were approved.",
    "No errors were found in the nightly run.",
    "Stock levels are checked every Monday.",
    "The committee meets again in spring.",
    "Please close the window before leaving.",
)

RECORD_TEMPLATES: dict[str, str] = {
    "personal_banking": (
        "PERSONAL BANKING CUSTOMER\nIdentity:\n- Name: {name}\n- SSN: {ssn}\n- Date: {dob}\n"
        "Contact:\n- Email: {email}\n- Phone: {phone_number}\nFinancial:\n- Card: {credit_card_number}\n"
        "- Account: {bank_account}\nNotes:\n"
    ),
    "intl_business": (
        "INTERNATIONAL BUSINESS CLIENT\nCompany:\n- Firm: {company}\n- Office: {address}\n"
        "Contact:\n- Email: {email}\n- Login: {username}\nTravel:\n- Passport: {passport}\n- Host: {ip_address}\n"
    ),
    "gov_contractor": (
        "GOVERNMENT CONTRACTOR\nEmployment:\n- Id: {emp_id}\n- License: {license}\n"
        "Devices:\n- Address: {mac_address}\n- Vehicle: {vin}\nContact:\n- Email: {email}\n"
    ),
    "healthcare_professional": (
        "HEALTHCARE PROFESSIONAL\nMedical:\n- Chart: {mrn}\n- Policy: {insurance}\n"
        "Contact:\n- Phone: {phone_number}\n- Email: {email}\nIdentity:\n- SSN: {ssn}\n"
    ),
    "tech_startup": (
        "TECH STARTUP EMPLOYEE\nAccess:\n- Key: {api_key}\n- Host: {ip_address}\n- Device: {mac_address}\n"
        "Contact:\n- Email: {email}\nFinancial:\n- Card: {credit_card_number}\n"
    ),
}


def _word(words: tuple[str, ...], *seed) -> Column:
    return F.get(F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")"), pick_index(len(words), *seed))


def _digits(n: int, *seed) -> Column:
    """``n`` decimal digits, the first one not zero."""
    text = F.concat(*[F.lpad((hash_number(*seed, i) % 10**7).cast("string"), 7, "0") for i in range((n + 6) // 7)])
    head = (hash_number(*seed, "head") % 9 + 1).cast("string")
    return F.concat(head, F.substring(text, 1, n - 1)) if n > 1 else head


def _hex(n: int, *seed) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in seed]
    return F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]).cast("binary")), 1, n)


def _luhn_digit(digits: Column) -> Column:
    """Check digit of 15 card digits."""
    total = F.lit(0)
    for i in range(1, 16):
        d = F.substring(digits, i, 1).cast("int")
        total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if i % 2 == 1 else d)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def values(row_id: Column, seed=42) -> dict[str, Column]:
    """One value expression per placeholder."""
    s = lambda key: (seed, row_id, key)
    name = F.concat(_word(FIRST_NAMES, *s("first")), F.lit(" "), _word(LAST_NAMES, *s("last")))
    user = F.concat(
        F.lower(_word(FIRST_NAMES, *s("first"))), F.lit("."), F.lower(_word(LAST_NAMES, *s("last"))), _digits(3, *s("user"))
    )
    card = let(F.concat(F.lit("4"), _digits(14, *s("card"))), lambda d: F.concat(d, _luhn_digit(d)))
    octets = [(hash_number(*s(f"ip{i}")) % 254 + 1).cast("string") for i in range(4)]
    day = F.lpad((hash_number(*s("day")) % 28 + 1).cast("string"), 2, "0")
    month = F.lpad((hash_number(*s("month")) % 12 + 1).cast("string"), 2, "0")
    year = (hash_number(*s("year")) % 60 + 1940).cast("string")
    mac = _hex(12, *s("mac"))
    vin_body = F.translate(F.upper(_hex(17, *s("vin"))), "IOQ", "JPR")
    return {
        "name": name,
        "address": F.concat(_digits(3, *s("house")), F.lit(" "), _word(STREETS, *s("street")), F.lit(", "), _word(CITIES, *s("city"))),
        "company": _word(COMPANIES, *s("company")),
        "email": F.concat(user, F.lit("@example.org")),
        "phone_number": F.concat(F.lit("("), _digits(3, *s("area")), F.lit(") 555-"), _digits(4, *s("phone"))),
        "ssn": F.concat((hash_number(*s("ssn")) % 500 + 100).cast("string"), F.lit("-"), _digits(2, *s("ssn2")), F.lit("-"), _digits(4, *s("ssn3"))),
        "credit_card_number": card,
        "dob": F.concat(month, F.lit("/"), day, F.lit("/"), year),
        "license": F.concat(F.upper(F.translate(_hex(1, *s("lic")), "0123456789", "ghjklmnpqr")), _digits(7, *s("license"))),
        "passport": _digits(9, *s("passport")),
        "ip_address": F.concat_ws(".", *octets),
        "mrn": F.concat(F.lit("MRN-"), _digits(6, *s("mrn"))),
        "bank_account": _digits(11, *s("bank")),
        "username": F.concat(F.lower(_word(LAST_NAMES, *s("last"))), _digits(2, *s("login")), F.lit("_admin")),
        "vin": vin_body,
        "api_key": F.concat(F.lit("sk_live_"), _hex(32, *s("api"))),
        "mac_address": F.upper(F.concat_ws(":", *[F.substring(mac, 2 * i + 1, 2) for i in range(6)])),
        "emp_id": F.concat(F.lit("EMP-"), _digits(4, *s("emp"))),
        "insurance": F.concat(F.lit("POL"), _digits(6, *s("insurance"))),
    }


def _parts_sql(templates) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    rows = []
    for template in templates:
        pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
        rows.append("array(" + ", ".join(quoted(p) for p in pieces) + ")")
    return "array(" + ", ".join(rows) + ")"


def with_filled(df: DataFrame, row_id: str, template_index: Column, templates, seed=42) -> DataFrame:
    """Fill one template per row: ``text`` and ``entities`` (start, end, label) on the output text."""
    made = values(F.col(row_id), seed)
    entries = []
    for key, value in made.items():
        entries += [F.lit("{" + key + "}"), value]
    staged = df.withColumn("_values", F.create_map(*entries)).withColumn(
        "_parts", F.get(F.expr(_parts_sql(templates)), template_index)
    )
    labels = F.expr("map(" + ", ".join(f"'{{{k}}}', '{v}'" for k, v in C.PLACEHOLDER_LABELS.items()) + ")")

    def pieces(b: Column) -> Column:
        return F.transform(
            b["parts"],
            lambda p: F.struct(
                F.coalesce(F.try_element_at(b["made"], p), p).alias("piece"), F.try_element_at(labels, p).alias("label")
            ),
        )

    bound = F.struct(F.col("_parts").alias("parts"), F.col("_values").alias("made"))
    cut = staged.withColumn("_pieces", let(bound, pieces))
    empty = F.struct(F.lit("").alias("text"), F.array().alias("entities")).cast(
        "struct<text:string,entities:array<struct<start:int,end:int,label:string>>>"
    )

    def step(acc: Column, p: Column) -> Column:
        start = F.length(acc["text"])
        text = F.concat(acc["text"], p["piece"])
        entity = F.struct(start.alias("start"), (start + F.length(p["piece"])).alias("end"), p["label"].alias("label"))
        return F.struct(
            text.alias("text"),
            F.when(p["label"].isNull(), acc["entities"]).otherwise(F.concat(acc["entities"], F.array(entity))).alias("entities"),
        )

    done = cut.withColumn("_made", F.aggregate("_pieces", empty, step))
    return done.withColumns({"text": F.col("_made.text"), "entities": F.col("_made.entities")}).drop(
        "_values", "_parts", "_pieces", "_made"
    )


def annotated_samples(df: DataFrame, row_id: str, seed=42, templates=SAMPLE_TEMPLATES) -> DataFrame:
    """One annotated sample per input row, template picked uniformly by hash."""
    index = pick_index(len(templates), seed, F.col(row_id), "template")
    return with_filled(df.select(row_id), row_id, index, templates, seed)


def allot_types(df: DataFrame, ordinal: str, total: Column) -> DataFrame:
    """Spread ``total`` dense ordinals over the record types: equal quotas, remainder to the first types.

    Adds ``record_type``, ``type_index`` and ``file_name``; arithmetic only, no sort and no shuffle.
    """
    names = list(C.RECORD_TYPES)
    n = len(names)
    base = F.floor(total / n).cast("long")
    extra = (total % n).cast("long")
    position = F.col(ordinal).cast("long")
    head = extra * (base + 1)
    index = F.when(position < head, F.floor(position / (base + 1))).otherwise(
        extra + F.floor((position - head) / F.greatest(base, F.lit(1)))
    ).cast("int")
    staged = df.withColumn("_base", base).withColumn("_extra", extra).withColumn("_type", index)
    first = F.col("_type") * F.col("_base") + F.least(F.col("_type").cast("long"), F.col("_extra"))
    return (
        staged.withColumn("record_type", F.get(F.expr("array(" + ", ".join(f"'{x}'" for x in names) + ")"), F.col("_type")))
        .withColumn("type_index", position - first)
        .withColumn("file_name", F.concat("record_type", F.lit("_"), F.format_string("%06d", F.col("type_index")), F.lit(".txt")))
        .drop("_base", "_extra", "_type")
    )


def records(df: DataFrame, row_id: str, seed=42) -> DataFrame:
    """Fill the record layout of each row's ``record_type``."""
    names = list(RECORD_TEMPLATES)
    index = F.expr("array_position(array(" + ", ".join(f"'{x}'" for x in names) + "), record_type)").cast("int") - 1
    return with_filled(df, row_id, index, list(RECORD_TEMPLATES.values()), seed)
