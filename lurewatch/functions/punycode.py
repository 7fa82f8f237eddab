"""Unicode form of host names in punycode (RFC 3492), as column expressions."""

from pyspark.sql import functions as F

DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Fixed values of the RFC.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
LARGEST = 0x10FFFF
#: A weight beyond this cannot belong to a code point.
HEAVIEST = 1 << 31


def _let(value, use):
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _long(n):
    return F.lit(n).cast("bigint")


def _state(codes, code, place, bias, weight, k, bad):
    parts = (codes, code, place, bias, weight, k, bad)
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("codes", "code", "place", "bias", "weight", "k", "bad"))])


def _whole(a, b):
    return F.floor(a / b).cast("bigint")


def _adapted(delta, first, points):
    """The bias after a delta: damped, spread over the code points so far, and scaled down by whole digits."""
    damped = F.when(first, _whole(delta, F.lit(DAMP))).otherwise(_whole(delta, F.lit(2)))
    limit = (BASE - T_MIN) * T_MAX // 2

    def scaled(spread):
        # A delta is below 2^37, so at most six divisions by 35 bring it down to the limit.
        found = F.lit(None).cast("bigint")
        for times in reversed(range(8)):
            left = _whole(spread, _long((BASE - T_MIN) ** times))
            bias = times * BASE + _whole((BASE - T_MIN + 1) * left, left + SKEW)
            found = F.when(left <= limit, bias).otherwise(found)
        return found

    return _let(_let(damped, lambda d: d + _whole(d, points)), scaled)


def _insert(s, place):
    """The state after a delta that ends at ``place`` (counted on from the last one, over all rounds of places)."""
    points = (F.size(s["codes"]) + 1).cast("bigint")
    code = s["code"] + _whole(place, points)
    at = (place % points).cast("int")
    codes = F.concat(F.slice(s["codes"], F.lit(1), at), F.array(code), F.slice(s["codes"], at + 1, F.size(s["codes"]) - at))
    bad = (code > LARGEST) | code.between(0xD800, 0xDFFF)
    bias = _adapted(place - s["place"], s["place"] == 0, points)
    return _state(codes, code, (at + 1).cast("bigint"), bias, _long(1), _long(BASE), bad)


def _digit(s, char):
    """The state after one more character. ``sum`` is the place so far inside a delta."""
    digit = (F.instr(F.lit(DIGITS), char) - 1).cast("bigint")
    limit = F.greatest(_long(T_MIN), F.least(_long(T_MAX), s["state"]["k"] - s["state"]["bias"]))
    both = F.struct(digit.alias("d"), limit.alias("t"), (s["sum"] + digit * s["state"]["weight"]).alias("sum"))

    def step(v):
        state = s["state"]
        heavier = _state(state["codes"], state["code"], state["place"], state["bias"],
                         state["weight"] * (BASE - v["t"]), state["k"] + BASE, (v["d"] < 0) | (state["weight"] > HEAVIEST))
        ends = (v["d"] >= 0) & (v["d"] < v["t"])
        inserted = _let(_insert(state, v["sum"]), lambda n: F.struct(n.alias("state"), n["place"].alias("sum")))
        return F.when(ends, inserted).otherwise(F.struct(heavier.alias("state"), v["sum"].alias("sum")))

    return F.when(s["state"]["bad"], s).otherwise(_let(both, step))


def decoded_label(label):
    """The Unicode form of a lower-cased ``xn--`` label. Other labels, and those that are no punycode, stay."""
    body = F.substr(label, F.lit(5))
    plain = F.regexp_extract(body, r"\A(.*)-", 1)
    rest = F.regexp_extract(body, r"([^-]*)\z", 1)
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    start = _state(codes, _long(FIRST_CODE), _long(0), _long(FIRST_BIAS), _long(1), _long(BASE), F.lit(False))
    chars = F.filter(F.split(rest, ""), lambda c: c != "")
    end = F.aggregate(chars, F.struct(start.alias("state"), _long(0).alias("sum")), _digit)

    def text(e):
        units = F.transform(e["state"]["codes"], lambda n: F.lpad(F.hex(n), 8, "0"))
        whole = ~e["state"]["bad"] & (e["state"]["k"] == BASE) & (rest != "")
        return F.when(whole, F.decode(F.unhex(F.array_join(units, "")), "UTF-32")).otherwise(label)

    return F.when(F.regexp_like(label, F.lit(r"\Axn--[a-z0-9-]+\z")), _let(end, text)).otherwise(label)


def unicode_rule(rule):
    """The same for a rule that the driver holds."""
    def label(text):
        try:
            return text[4:].encode("ascii").decode("punycode") if text.startswith("xn--") and text[4:] else text
        except UnicodeError:
            return text

    return ".".join(map(label, rule.split(".")))


def unicode_host(host):
    """A lower-cased host with its punycode labels decoded; it keeps its number of labels. No work for other hosts."""
    labels = F.transform(F.split(host, r"\."), decoded_label)
    return F.when(F.contains(host, F.lit("xn--")), F.array_join(labels, ".")).otherwise(host)
