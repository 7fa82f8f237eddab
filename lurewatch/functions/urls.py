"""Lexical url features as native column expressions: no join, no shuffle, no Python in the tasks."""

from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import punycode as P
from lurewatch.functions import strings as S

# One pass over the url; tab and line breaks are removed before, so a line feed can part the groups.
_URL_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*).*\z"
_DOTTED_QUAD = r"\A\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H16 = r"[0-9A-Fa-f]{1,4}"
_LS32 = rf"(?:{_H16}:{_H16}|{_IPV4})"
# The nine alternatives of the IPv6address rule of RFC 3986, and an optional zone.
_IPV6 = "(?:" + "|".join(
    [rf"(?:{_H16}:){{6}}{_LS32}", rf"::(?:{_H16}:){{5}}{_LS32}"]
    + [rf"(?:(?:{_H16}:){{0,{n}}}{_H16})?::(?:{_H16}:){{{4 - n}}}{_LS32}" for n in range(5)]
    + [rf"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}", rf"(?:(?:{_H16}:){{0,6}}{_H16})?::"]
) + r")(?:%[^%]+)?"
_BRACKETED_HOST = rf"(?s)\A(?:{_IPV6}|v[0-9A-Fa-f]+\.[^\n]+)\z"
_HOST_END_DOTS = r"[.\x{3002}\x{ff0e}\x{ff61}]+\z"


def url_parts(url):
    """struct<scheme, netloc, path> of a url, as a generic RFC 3986 splitter with ``;params`` removed."""
    clean = F.translate(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), "\t\r\n", "")
    parts = F.split(F.regexp_replace(clean, _URL_PARTS, "$1\n$2\n$3"), "\n")
    scheme = F.lower(F.get(parts, 0))
    path = F.get(parts, 2)
    path = F.when(scheme.isin(K.PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path)
    return F.struct(scheme.alias("scheme"), F.get(parts, 1).alias("netloc"), path.alias("path"))


def is_malformed(netloc):
    """Network locations that a strict splitter refuses."""
    opened, closed = F.contains(netloc, F.lit("[")), F.contains(netloc, F.lit("]"))
    bracketed = F.substring_index(F.regexp_replace(netloc, r"(?s)\A[^\[]*\[", ""), "]", 1)
    bad_host = opened & closed & ~F.regexp_like(bracketed, F.lit(_BRACKETED_HOST))
    lookalike = F.regexp_like(netloc, F.lit(f"[{K.DELIMITER_LOOKALIKES}]"))
    return (opened != closed) | bad_host | (~S.is_ascii(netloc) & lookalike)


def lenient_host(url):
    """The host of a url whose scheme may be missing; brackets of an IPv6 host are kept."""
    start = F.regexp_replace(url, r"\A(?:[A-Za-z0-9+.\-]+:)?//", "")
    authority = F.regexp_extract(start, r"\A[^/?#]*", 0)
    host = S.strip(F.substring_index(authority, "@", -1))
    bracketed = F.regexp_extract(host, r"(?s)\A\[[^\]]*\]", 0)
    plain = F.regexp_replace(S.strip(F.substring_index(host, ":", 1)), _HOST_END_DOTS, "")
    return F.translate(F.when(bracketed != "", bracketed).otherwise(plain), "。．｡", "...")


def rule_host(host):
    """The form of a host that rules are compared with: lower case, punycode labels in Unicode."""
    return P.unicode_host(F.lower(host))


def is_ip_host(host):
    """Hosts that have no suffix: an IPv4 address or a bracketed IPv6 address."""
    return F.regexp_like(host, F.lit(rf"\A(?:{_IPV4}|\[{_IPV6}\])\z"))


class SuffixRules:
    """Public-suffix rules held as literals in the plan, so matching needs no join. Rules in punycode and in
    Unicode are the same."""

    def __init__(self, rules=K.DEFAULT_SUFFIXES):
        rules = [P.unicode_rule(r.strip().lower()) for r in rules]
        self.exceptions = [r[1:] for r in rules if r.startswith("!")]
        self.wildcards = [r[2:] for r in rules if r.startswith("*.")]
        self.plain = [r for r in rules if not r.startswith(("!", "*."))]
        self.max_labels = max((r.count(".") + 1 for r in rules), default=1)

    def as_list(self):
        return [*self.plain, *[f"*.{r}" for r in self.wildcards], *[f"!{r}" for r in self.exceptions]]

    def suffix_labels(self, host):
        """How many labels at the end of a host as ``rule_host`` gives it form its public suffix; 0 if none is known."""
        labels = S.count_char(host, ".") + 1

        def tail(k):
            return F.call_function("substring_index", host, F.lit("."), -k)

        def matched(k):
            under_wildcard = (k > 1) & tail(k - 1).isin(self.wildcards)
            return (
                F.when(tail(k).isin(self.exceptions), k - 1)
                .when(tail(k).isin(self.plain) | under_wildcard, k)
                .otherwise(F.lit(0))
            )

        ends = F.sequence(F.lit(1), F.least(labels, F.lit(self.max_labels)))
        return F.coalesce(F.array_max(F.transform(ends, matched)), F.lit(0))


def split_host(host, suffix_labels):
    """struct<subdomain, domain, suffix> given the number of labels of the public suffix."""
    ip = is_ip_host(host)
    labels = F.split(host, r"\.")
    rest = F.size(labels) - suffix_labels

    def join(start, length):
        return F.array_join(F.slice(labels, start, F.greatest(length, F.lit(0))), ".")

    domain = F.when(ip, host).when(rest > 0, F.get(labels, rest - 1)).otherwise(F.lit(""))
    subdomain = F.when(ip, F.lit("")).otherwise(join(F.lit(1), rest - 1))
    suffix = F.when(ip, F.lit("")).otherwise(join(rest + 1, suffix_labels))
    return F.struct(subdomain.alias("subdomain"), domain.alias("domain"), suffix.alias("suffix"))


def is_risky_ending(url):
    ending = F.lower(url)
    risky = F.lit(False)
    for tld in K.RISKY_TLDS:
        risky = risky | F.endswith(ending, F.lit(tld))
    return risky


def suspicious_tokens(url):
    """Number of different listed words that occur in the url."""
    lowered = F.lower(url)
    return sum((F.contains(lowered, F.lit(w)).cast("int") for w in K.SUSPICIOUS_TOKENS), F.lit(0))


def feature_columns(url, parts, host_parts):
    """The model inputs by name. ``parts`` and ``host_parts`` are columns, so each is computed once."""
    netloc, domain, subdomain = parts["netloc"], host_parts["domain"], host_parts["subdomain"]
    ip = F.regexp_like(netloc, F.lit(_DOTTED_QUAD))
    features = {
        "url_length": F.char_length(url),
        "domain_length": F.char_length(domain),
        "path_length": F.char_length(parts["path"]),
        **{name: S.count_char(url, char) for name, char in K.COUNTED_CHARS.items()},
        "num_digits": S.count_digits(url),
        "url_entropy": S.entropy(url),
        "domain_entropy": S.entropy(domain),
        "has_ip_address": ip,
        "suspicious_token_count": suspicious_tokens(url),
        "has_risky_tld": is_risky_ending(url),
        "is_https": parts["scheme"] == "https",
        "has_port": F.contains(netloc, F.lit(":")) & ~ip,
        "subdomain_count": F.when(subdomain != "", S.count_char(subdomain, ".") + 1).otherwise(F.lit(0)),
        "domain_has_digits": S.has_digit(domain),
    }
    return {
        name: features[name].cast("double" if name in K.ENTROPY_FEATURES else "int") for name in K.URL_FEATURES
    }
