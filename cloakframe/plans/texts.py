"""Texts built from the given tables, written so that Spark and other engines read them alike.

The test documents hit few patterns, so each entity gets a line with hits and
near misses made of a customer's own numbers.
"""

from __future__ import annotations

K = "c_custkey"
D4, D6, D7, D8, D9, D10 = "d4", "d6", "d7", "d8", "d9", "d10"
HEX, UP, VIN, LET = "hex", "up", "vin", "let"

# A customer's numbers as columns; texts are then flat concatenations of them.
NUMBERS = f"""SELECT c_custkey, c_nationkey, d4, d6, d7, d8, '4' || d8 AS d9, d10, hex,
  upper(substr(hex, 1, 8)) AS up, upper(translate(substr(hex, 1, 17), 'ioq', 'jpr')) AS vin,
  translate(substr(hex, 1, 6), '0123456789', 'ghjkmnprst') AS let
FROM (SELECT c_custkey, c_nationkey, lpad(cast({K} % 10000 as string), 4, '0') AS d4,
  lpad(cast(({K} * 7919 + 100003) % 1000000 as string), 6, '0') AS d6,
  lpad(cast(({K} * 7919 + 1234567) % 10000000 as string), 7, '0') AS d7,
  lpad(cast(({K} * 7919 + 12345678) % 100000000 as string), 8, '0') AS d8,
  '9434765' || lpad(cast({K} % 1000 as string), 3, '0') AS d10,
  md5(cast({K} as string)) AS hex FROM {{customer}})"""

ENTITY_TEXT: dict[str, str] = {
    "PROJECT_ID": f"'research PROJ-' || {D4} || ' beside PROJ-' || substr({D4}, 1, 3) || ' é PROJ-' || {D4} || '.'",
    "PASSPORT_NUMBER": f"'passport ' || {D9} || ' code C' || {D8} || ' not ' || {D7} || '5123 end'",
    "DRIVERS_LICENSE": f"'driver license A' || {D7} || ' or ' || {D7} || ' not ' || {D4}",
    "MEDICAL_RECORD_NUMBER": f"'chart MRN-' || {D6} || ', MRN: ' || {D7} || ', Patient ' || {D8} || ', MRN-' || substr({D6}, 1, 5)",
    "BANK_ACCOUNT": f"'bank ' || {D8} || {D4} || ' and Account #' || {D9} || ' but ' || {D6}",
    "INSURANCE_NUMBER": f"'claim POL' || {D6} || ' Policy-AB' || {D6} || ' Member: ' || {UP} || ' P' || {D4}",
    "EMPLOYEE_ID": f"'payroll EMP-' || {D4} || ' E' || {D6} || ' EMPL:' || {D7} || ' EMP-' || substr({D4}, 1, 3)",
    "DATE_OF_BIRTH": f"'born 12/25/19' || substr({D4}, 3, 2) || ' DOB: 1-2-' || substr({D4}, 1, 4) || ' also 13/45/1990'",
    "TAX_ID": f"'employer 12-' || {D7} || ' EIN: 98' || {D7} || ' no 1-' || {D7}",
    "VIN": f"'vehicle ' || {VIN} || ' VIN: ' || {VIN} || ' short ' || substr({VIN}, 1, 16)",
    "API_KEY": f"'auth ' || {HEX} || ' API KEY: ' || substr({HEX}, 1, 24) || ' token=\"' || substr({HEX}, 1, 20) || '\" part ' || substr({HEX}, 1, 12)",
    "USERNAME": f"'login: bob' || {D4} || ' and ' || {LET} || '_admin or ' || {LET} || '_guest, user=x' || {D4}",
    "MAC_ADDRESS": f"'ethernet ' || substr({HEX}, 1, 2) || ':' || substr({HEX}, 3, 2) || ':' || substr({HEX}, 5, 2) || ':' || substr({HEX}, 7, 2) || ':0A:1b not ' || substr({HEX}, 1, 2) || ':' || substr({HEX}, 3, 2)",
    "SECURITY_BADGE": f"'badge AB-' || {D6} || ' TS/SCI and TOP  SECRET, secretive AC-' || {D4} || '-ABCD-EFGHI or confidential.'",
    "GRANT_NUMBER": f"'NIH-' || {D4} || '-' || {D6} || ' Contract: ' || {UP} || ' IRB-' || {D4} || '-' || {D4} || ' GRANT-' || {D4} || '-123 NIH-' || {D6}",
    "AWS_KEY": f"'cloud AKIA' || upper(substr({HEX}, 1, 16)) || ' aws_secret_key: ' || {HEX} || substr({HEX}, 1, 8) || ' AKIA' || {D4}",
    "SERVICE_API_KEY": f"'stripe sk_live_' || substr({HEX}, 1, 24) || ' sk-proj-' || substr({HEX}, 1, 22) || ' sk-' || substr({HEX}, 1, 21) || ' sk-' || {D4}",
    "DB_CONNECTION": f"'database postgresql://u:p@host' || {D4} || ':5432/db then redis://cache:' || {D4} || ' and mysql://h' || {D4} || '/x, mongo://none'",
    "LICENSE_PLATE": f"'vehicle License Plate: AB' || {D4} || ' Plate ' || {UP} || ' Plate: A1'",
    "PROFESSIONAL_LICENSE": f"'doctor NPI: ' || {D10} || ' or ' || {D10} || ' DEA AB' || {D7} || ' MD-A' || {D6} || ' medical XY' || {D7} || ' NPI ' || {D6}",
    "CVV": f"'card CVV: ' || substr({D4}, 2, 3) || ' Security Code ' || {D4} || ' CVC-' || substr({D4}, 1, 3) || ' CVV ' || substr({D4}, 1, 2)",
    "MEDICARE_NUMBER": f"'health 1EG4-TE5-' || substr({D4}, 1, 2) || ' 12AB-CD-' || {D4} || ' Medicare: ' || {UP} || '-' || substr({D4}, 1, 2) || ' Medicare ' || {D4}",
    "PATENT_NUMBER": f"'filing US-' || {D4} || '-' || {D6} || ' TS-' || {D4} || '-ABCD-001 EP' || {D8} || 'A1 US-' || {D4}",
    "EMAIL_ADDRESS": f"'write ' || {LET} || '.x+' || {D4} || '@mail' || {D4} || '.example.org or ' || {LET} || '@host only'",
    "PHONE_NUMBER": f"'call (212) 555-' || {D4} || ' or 415-555-' || {D4} || ' or +49 30 ' || {D7} || ' not 55-' || {D4}",
    "CREDIT_CARD": f"'card 41111111' || {D8} || ' or 4111 1111 1111 ' || {D4} || ' or ' || {D9}",
    "IP_ADDRESS": f"'host 10.' || cast({K} % 256 as string) || '.0.7 and 300.1.1.1 or 2001:db8:0:0:0:0:0:' || substr({HEX}, 1, 4) || ' or fe80::' || substr({HEX}, 1, 4) || ' end'",
    "URL": f"'see https://example.org/a/' || {D4} || '?x=1, or http://h' || {D4} || '.net. ftp://no'",
    "US_SSN": f"'ssn 123-45-' || {D4} || ' or 000-12-' || {D4} || ' or 666-12-' || {D4}",
    "US_ITIN": f"'itin 912-70-' || {D4} || ' or 912-40-' || {D4}",
    "IBAN_CODE": f"'iban GB82WEST12345698765432 or GB' || substr({D4}, 3, 2) || 'WEST12345698765432 or GB82 WEST 1234 5698 7654 32 or DE' || {D4}",
    "CRYPTO": f"'pay 1A' || translate({HEX}, '0', '2') || ' or bc1' || {HEX} || ' or 1' || {D4}",
    "US_BANK_NUMBER": f"'bank ' || {D10} || ' or ' || {D6}",
    "US_DRIVER_LICENSE": f"'license B' || {D8} || {D4} || ' or C123-' || {D4} || '-5678 or D' || {D7}",
    "US_PASSPORT": f"'visa ' || {D9} || ' or P' || {D8} || ' or ' || {D7}",
    "UK_NHS": f"'nhs 943 476 5' || lpad(cast({K} % 1000 as string), 3, '0') || ' or ' || {D10} || ' or 943 476'",
    "MEDICAL_LICENSE": f"'dea AB' || {D7} || ' or AB1234563 or ZZ' || {D7}",
}



def flat(pieces: str) -> str:
    """A chain of ``||`` as one ``concat``."""
    return "concat(" + pieces.replace(" || ", ", ") + ")"


# One text per customer with every entity on its own line.
ALL_TEXT = " || ' ;\n' || ".join(ENTITY_TEXT.values())


def sql_newlines(expr: str) -> str:
    """The same expression for an engine whose literals have no escapes."""
    return expr.replace("\n", "' || chr(10) || '")
