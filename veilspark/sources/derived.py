"""Query inputs derived from the given tables, one row of a table giving one row here.

The formulas are plain SQL that any engine can run, so a check elsewhere can
build the same input. The test numbers in them are the well-known public ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .files import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pad(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as string), {width}, '0')"


def guid(expr: str) -> str:
    m = f"md5(cast({expr} as string))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({m}, {a}, {n})" for a, n in cuts)


def s(expr: str) -> str:
    return f"cast({expr} as string)"


_CARD = """case k % 5 when 0 then '4111-1111-1111-1111' when 1 then '4242424242424242'
 when 2 then '378282246310005' when 3 then '5555555555554444' else '4111-1111-1111-1112' end"""
_IBAN = """case k % 4 when 0 then 'DE89370400440532013000' when 1 then 'GB82WEST12345698765432'
 when 2 then 'FR1420041010050500013M02606' else 'DE00370400440532013000' end"""
_RIVER = "case k % 4 when 0 then 'Tees' when 1 then 'Trent' when 2 then 'Sea' else 'Avon' end"
_SSN = f"{pad('100 + k % 500', 3)} || '-' || {pad('1 + k % 98', 2)} || '-' || {pad('1 + k % 9998', 4)}"

# Text of a message, from order number o and customer number k.
MESSAGE = f"""case o % 6
 when 0 then 'Please call 555-' || {pad('k % 1000', 3)} || '-' || {pad('k % 10000', 4)}
  || ' or (555) ' || {pad('k % 1000', 3)} || '-' || {pad('o % 10000', 4)}
  || '. My SSN is ' || {_SSN} || ', thanks.'
 when 1 then 'Login from 10.' || {s('k % 256')} || '.' || {s('o % 256')} || '.0/24 and 45.'
  || {s('k % 200')} || '.' || {s('k % 256')} || '.7; session id ' || {guid('k')} || ' closed.'
 when 2 then 'Write to client' || {s('k')} || '@mail' || {s('k % 5')} || '.example.com, born 19'
  || {pad('50 + k % 50', 2)} || '-0' || {s('1 + k % 9')} || '-1' || {s('k % 10')} || ', card ' || {_CARD} || '.'
 when 3 then 'Deliver to ' || {s('1 + k % 900')} || ' Oak Street, Apt ' || {s('1 + k % 40')}
  || 'B, then Newton-On-' || {_RIVER} || ' at ' || {s('k % 180')} || '.' || {pad('k * 7919 % 1000000', 6)}
 when 4 then 'Bank account ' || {pad('k * 7919', 10)} || ' passport X' || {pad('k', 8)} || ', iban ' || {_IBAN}
  || ', wallet bc1' || md5({s('k')}) || ', see https://shop' || {s('k % 7')} || '.example.com/o/' || {s('o')}
 else 'Nothing to report for order ' || {s('o')} end"""


# One text per customer for each type that the given texts lack.
PROBES = {
    "street": f"""case k % 3 when 0 then 'ship to ' || {s('1 + k % 99999')} || ' Long Meadow Street'
 when 1 then {s('k')} || ' Oak Avenue, Suite ' || {s('k % 300')} else 'gate ' || {s('k')} || ' Pine Rd. closed' end""",
    "ssn": f"""case k % 4 when 0 then 'ssn ' when 1 then 'social security no. ' when 2 then 'code '
 else 'SS# ' end || case k % 5 when 0 then '666' when 1 then '901' when 2 then '000'
 else {pad('100 + k % 500', 3)} end || case when k % 2 = 0 then '-' else '' end || {pad('k % 98', 2)}
 || case when k % 2 = 0 then '-' else '' end || {pad('k % 9998', 4)}""",
    "date": f"""case k % 4 when 0 then 'born ' when 1 then 'Date of Birth: ' when 2 then 'on '
 else 'expires ' end || case k % 3 when 0 then '19' || {pad('k % 100', 2)} || '-' || {s('1 + k % 12')} || '-' || {pad('1 + k % 28', 2)}
 when 1 then {s('1 + k % 12')} || '/' || {s('1 + k % 31')} || '/20' || {pad('k % 30', 2)}
 else 'March ' || {s('1 + k % 28')} || ', ' || {s('1900 + k % 120')} end || ' noted'""",
    "location": f"""case k % 4 when 0 then 'Stockton-On-' || {_RIVER} when 1 then 'Newcastle upon ' || {_RIVER}
 when 2 then 'stockton-on-tees ' || {s('k')} else 'Stow-In-The-Wold near ' || {_RIVER} end""",
    "guid": f"""case k % 3 when 0 then 'user ' when 1 then 'x' else '' end || {guid('k')} || case k % 5 when 0 then 'f' else '' end""",
    "coordinate": f"""case k % 2 when 0 then 'lat ' else '-' end || {s('k % 180')} || '.' || {pad('k * 7919 % 1000000', 6)}
 || case k % 3 when 0 then '' else ', ' || {s('k % 90')} || '.12345' end""",
    "phone": f"""case k % 3 when 0 then 'call me at ' when 1 then 'ref ' else '' end || case k % 4
 when 0 then '555-' || {pad('k % 1000', 3)} || '-' || {pad('k % 10000', 4)} when 1 then '(555) ' || {pad('k % 1000', 3)} || '.' || {pad('k % 10000', 4)}
 when 2 then '555' || {pad('k % 1000', 3)} || {pad('k % 10000', 4)} else '555.' || {pad('k % 1000', 3)} || ' ' || {pad('k % 10000', 4)} end""",
    "ipv6": f"""'from ' || case k % 6 when 0 then '2001:0db8:85a3:0000:0000:8a2e:' || {s('1000 + k % 9000')} || ':7334'
 when 1 then '2a02:' || {s('k % 9999')} || '::1' when 2 then 'fe80::' || {s('k % 9999')} || ':1:2/64'
 when 3 then 'fd00:' || {s('k % 999')} || '::/' || {s('k % 129')} when 4 then '2600::/' || {s('k % 130')}
 else 'std::vector and 00:1a:2b:3c:4d:5e at 12:30:' || {s('10 + k % 50')} end || ' ok'""",
    "phone_abroad": f"""'reach ' || case k % 6 when 0 then '+44 20 7' || {pad('k % 1000', 3)} || ' ' || {pad('k % 10000', 4)}
 when 1 then '+49 30 ' || {pad('k % 10000000', 7)} when 2 then '+1 (555) ' || {pad('k % 1000', 3)} || '-' || {pad('k % 10000', 4)}
 when 3 then '+358' || {pad('k % 10000000', 9)} when 4 then '+' || {s('k % 10')} || '.5' else 'a+12345 or C++ 2011' end || '.'""",
    "card": f"""'paid with ' || {_CARD} || ' by ' || {s('4000000000000000 + k')} || '.'""",
    "iban": f"""'to ' || {_IBAN} || ' from DE' || {pad('k % 97 + 2', 2)} || {pad('k * 7919', 18)}""",
    "crypto": f"""case k % 3 when 0 then 'bc1' || md5({s('k')}) when 1 then '1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN' || {s('1 + k % 9')}
 else '2' || md5({s('k')}) end || ' paid'""",
    "us_ids": f"""case k % 6 when 0 then 'itin 9' || {pad('k % 100', 2)} || '-7' || {s('k % 10')} || '-' || {pad('k % 10000', 4)}
 when 1 then 'passport no. ' || {pad('100000000 + k', 9)} when 2 then 'bank account ' || {pad('k * 31 + 10000000', 12)}
 when 3 then 'driver license A' || {pad('k', 12)} when 4 then 'medical license ML' || {pad('k', 6)}
 else 'lot ' || {pad('100000000 + k', 9)} end""",
}

# Addresses of every kind.
_IP = f"""case k % 8 when 0 then '10.' || {s('k % 256')} || '.0.0/16'
 when 1 then '192.168.' || {s('k % 256')} || '.' || {s('k % 256')}
 when 2 then '172.' || {s('k % 40')} || '.3.4/24' when 3 then {s('n % 224')} || '.' || {s('n % 251')} || '.' || {s('k % 256')} || '.0/24'
 when 4 then {s('1 + n % 223')} || '.' || {s('n % 256')} || '.1.' || {s('k % 256')}
 when 5 then '169.254.1.' || {s('k % 256')} || '/33' when 6 then '010.1.2.' || {s('k % 300')}
 else '127.0.0.0/' || {s('k % 33')} end"""

# Sign-in records shaped after the customer of an order: thirteen plain fields, two
# JSON texts, blanks and marks of an earlier run. Coordinates end in 7 so that a
# JSON number loses no digit.
_LOCATION = f"""case k % 10 when 7 then 'not json' else '{{"city":"' || case k % 5
 when 0 then 'Newton-On-Tees' when 1 then '{{PII' || {s('k')} || '}}' when 2 then ''
 else 'Town' || {s('k % 7')} end || '","state":"Stow-In-The-Wold","countryOrRegion":"GB","geoCoordinates":{{"latitude":'
 || {s('k % 90')} || '.' || {pad('k * 7919 % 100000', 5)} || '7,"longitude":-' || {s('100 + k % 80')} || '.'
 || {pad('k * 104729 % 100000', 5)} || '7}}}}' end"""
_DEVICE = f"""'{{"deviceId":"' || {guid('k + 1')} || '","displayName":"'
 || case when k % 2 = 0 then 'pc' || {s('k')} || '@corp.example.com' else '' end
 || '","operatingSystem":"Linux","isManaged":true}}'"""


@dataclass(frozen=True)
class Derived:
    """A table, names for its columns, and the columns computed from them.

    With ``times`` each row comes that often, numbered from 1 as ``n``.
    """

    source: str
    base: dict[str, str]
    columns: dict[str, str]
    times: int = 0

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        base = [f"{e} as {n}" for n, e in self.base.items()]
        if self.times:
            base.append(f"explode(sequence(1, {self.times})) as n")
        renamed = spread(table(spark, folder, self.source).selectExpr(*base))
        return renamed.selectExpr(*[f"{e} as {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        outer = ", ".join(f"{e} as {n}" for n, e in self.columns.items())
        inner = ", ".join(f"{e} as {n}" for n, e in self.base.items())
        if self.times:
            inner += f", unnest(range(1, {self.times + 1})) as n"
        return f"select {outer} from (select {inner} from {self.source}) q"


_ORDER = {"o": "o_orderkey", "k": "o_custkey", "sent": "o_orderdate"}
_CUSTOMER = {"k": "c_custkey", "nation": "c_nationkey"}

MESSAGES = Derived("orders", _ORDER, {"id": "o", "sent": "sent", "sender": "k", "text": MESSAGE})
PROBE = {
    name: Derived("customer", _CUSTOMER, {"id": "k", "text": text})
    for name, text in PROBES.items()
}
IPS = Derived("customer", {"k": "c_custkey", "n": "c_custkey * 48271 % 2147483647"},
              {"id": "k", "ip": _IP})
SIGNINS = Derived("orders", _ORDER, {
    "entry": "o",
    "TimeGenerated": "sent",
    "DurationMs": "o % 900",
    "IsInteractive": "o % 2 = 0",
    "Identity": f"'User' || {s('k % 10')} || ' at ' || {s('k')} || '@corp.example.com'",
    "UserDisplayName": f"case k % 10 when 0 then '  ' when 1 then '' else 'client' || {s('k')} || '@corp.example.com' end",
    "UserPrincipalName": f"'client' || {s('k')} || '@corp.example.com'",
    "AlternateSignInName": f"case when k % 4 = 0 then 'alt' || {s('k')} || '@mail.example.org' end",
    "SignInIdentifier": f"case when k % 3 = 0 then 'client' || {s('k')} || '@corp.example.com' end",
    "IPAddress": f"case when o % 3 = 0 then '185.10.20.30' else '45.' || {s('k % 256')} || '.' || {s('o % 256')} || '.9' end",
    "IPAddressFromResourceProvider": f"case when o % 2 = 0 then '10.0.' || {s('k % 256')} || '.1' end",
    "UserId": guid("k"),
    "SessionId": guid("o"),
    "CorrelationId": guid("o * 3"),
    "Id": guid("o * 5"),
    "OriginalRequestId": guid("o * 5"),
    "UniqueTokenIdentifier": f"'tok' || {s('o')}",
    "LocationDetails": _LOCATION,
    "DeviceDetail": _DEVICE,
})
# Names: a first and a last part chosen by key, with the nation of the customer.
NAMES = Derived("customer", _CUSTOMER, {
    "id": "k",
    "nation": "nation",
    "name": f"""case k % 7 when 0 then 'Ива Петров' || {s('k % 3')} when 1 then 'É' || substr(md5({s('k')}), 1, 1) || 'a-Lu' when 2 then ''
 else 'Fa' || {s('k % 13')} || ' B. La' || {s('k % 17')} end""",
})
