"""Columns of opened-mail events."""

from pyspark.sql import functions as F

from lurewatch import constants as K

# First web address in a text; it ends before white space, quotes and angle brackets.
FIRST_URL_PATTERN = r"https?://[^\s<>\"']+"


def mail_id(address_hash):
    """Mail id of an inbox address; null where the address is not that of an opened mail."""
    return F.nullif(F.regexp_extract(address_hash, K.MAIL_HASH_PATTERN, 1), F.lit(""))


def first_url(text):
    return F.nullif(F.regexp_extract(text, FIRST_URL_PATTERN, 0), F.lit(""))
