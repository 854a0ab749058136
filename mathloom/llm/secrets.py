"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

Three patterns are always reported (kinds ``assign``, ``access`` and ``hex``). The method adds
kind ``novel``. Candidates are the maximal runs of at least ``LEAST`` key-like characters in a
sensitive context: one of ``HINTS`` ends at most ``NEAR`` characters before the run or starts in
its first ``LEAST`` characters, or the run follows a run in such a context after a line break (a
wrapped key). Each run is met once, from its start to its end. It is compressed, whole, after the
text around it, by zstandard primed with dictionaries of code, words and identifiers; once as it
stands and once in lower case, and the smaller number counts. The bytes that it adds, its marginal
bytes, over its length are its novelty; identifiers, words, paths and repeats of what stands
around it compress well, random keys do not. Runs that no fixed span overlaps are reported if
their novelty is ``CUTOFF`` or more; as the codes of long runs come close to the entropy of their
alphabet, from ``LONG`` characters on the limit falls towards ``DENSE`` of that entropy. Runs with
only a line break between them are also measured together, as one run, and reported if that is.

Offsets are code points, ends exclusive. Spans are ordered by start, then by kind as listed.
Defined results: null text counts as empty and has no span; repeated rows are scanned each
for itself; the scan of a row needs that row alone. Texts are scanned whole, one at a time, in
time that grows with their length alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from math import log2

import zstandard
from pyspark.sql import DataFrame

from mathloom.llm import common

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST, NEAR = 16, 48
CUTOFF, LONG, DENSE = 0.73, 32, 0.9
HINTS = re.compile(r"key|secret|token|passw|pwd|credential|auth|bearer|private|akia|signature", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: How many characters there are of each class that a lower-case run may have.
ALPHABETS = ((re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[^0-9a-z]"), 5))
HEXADECIMAL = re.compile("[0-9a-f]+")
#: What may stand between the lines of a wrapped key.
WRAP = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
#: Characters of text before and after a run that it is compressed with.
BEFORE, AFTER = 256, 128
#: Words whose lower-case presence makes the assign pattern worth running.
STARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CODE = b"""
import os, sys, re, json, logging, typing
def __init__(self, config, session=None, timeout=30, retries=3): return self.client.get(url, headers=headers)
public static final String class interface extends implements private protected void return new this null true false
function async await const let var export default require module.exports = { } => console.log(error)
if err != nil { return nil, fmt.Errorf("failed to load configuration: %w", err) } #include <stdio.h> int main(void)
SELECT id, name, created_at, updated_at FROM users WHERE user_id = ? ORDER BY created_at DESC LIMIT 100;
Authorization: Bearer Content-Type: application/json Accept: text/html User-Agent: Mozilla/5.0 https://www.example.com/api/v1/
-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- ssh-rsa password= secret= token= api_key= aws_access_key_id aws_secret_access_key
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ ================ ---------------- ________________
"""
WORDS = b"""
account action active adapter address admin agent alert alias allow amount analysis android anonymous application archive argument array assert asset async attribute audio
authority auto average backup balance base batch bean bearer before binary block body boolean boundary branch broker browser bucket buffer build builder bundle button byte cache
calculate callback cancel cart catalog category certificate channel character chart check checkbox child chunk class cleanup click client clone close cloud cluster code collection
color column command comment commit common compare component computer condition config connect connection console constant contact container content context control controller
convert cookie copy core count counter country create created credential currency current cursor custom customer dashboard data database datasource date debug default define delete
delivery dependency deploy description destination detail device dialog dictionary direct directory disable dispatch display document domain double download driver duration dynamic
edit editor element email embed empty enable encode encoding encrypt endpoint engine entity entry enum environment error event example exception execute executor expire export
expression extension external extra factory failure feature field file filter final finish first fixed flag float folder font footer foreign format forward frame framework function
gateway general generate generator generic global graph group guide handle handler hash header health height hidden history home host hook html http icon identifier image
implementation import include index info init inner input insert install instance integer interface internal interval invalid invoice item iterator java javascript join json kernel
keyboard keyword kubernetes label language large last latest layer layout lazy left length level library license lifecycle limit line link linux list listener load local locale
location lock logger login logout long lookup machine mail main manager manifest map mapper margin mask master match material maximum measure media member memory menu merge message
meta metadata meter method metric migrate minimum mobile mock mode model modify module monitor month mount mouse move multi multiple mutation name namespace native navigation
nested network node normal notification null number object observer offset online open operation operator option order organization origin output overflow overlay owner package
padding page pagination panel parameter parent parse parser partial partition passphrase password patch path pattern payload payment pending percent performance permission persist
person phone picker pipeline pixel place platform player plugin point policy pool popup port position post prefix prepare preview previous price primary print priority private
process processor product production profile program progress project promise property protocol provider proxy public publish purchase query queue quick random range rate reader
record redirect reduce reference refresh region register registry release reload remote remove rename render repeat replace reply report repository request require reset resize
resolve resolver resource response restart restore result retry return reverse review right role root rotate router row rule runtime sample save scale schedule scheduler schema
scope score screen script scroll search second secondary section secure security segment select selection selector sender sensor separator sequence serial serialize server service
session setting setup shadow shape share sheet shell shipping short shutdown signal signature simple single site size slice small snapshot socket software sort source space special
specification spring stack staging standard start state static statistics status step stop storage store stream strict string structure student style subject submit subscribe
success summary support suspend switch symbol sync system table target task template temporary tenant terminal test text theme thread threshold thumbnail ticket time timeline
timestamp title toggle token tool toolbar topic total trace track transaction transfer transform transient translate transport trigger type unique unit unknown unlock update
upgrade upload usage user util utils valid validate validation validator value variable vector vendor verify version vertical video view virtual visible volume wallet warning watch
webhook website webpack week weight widget width window wizard word worker workflow workspace wrapper writer year zone
able ation ative ment ness tion ible ical istic ology ability ational ization counter electro hyper inter micro multi over photo pseudo psycho under misunder standing comprehens
revolution revolutionary responsib ilities graph gram ally edly ingly fully lessly
lib/python/site-packages usr/local/bin/etc/var/log/opt/home/src/main/java/com/org/net/www/index.html wp-content/uploads node_modules/ 2020-01-01 2021-02-03 2022-04-05 2023-06-07
2024-08-09 2025-10-12 1234567890 0000000000000000
"""
IDENTIFIERS = b"""
access_token refresh_token client_id client_secret session_key private_key public_key encryption_key database_password
authentication authorization configuration connection_string environment_variable application_properties
getElementById addEventListener createConnection processRequest validateInput parseResponse handleException
user_name first_name last_name email_address phone_number account_number transaction_identifier request_timestamp
example changeme placeholder your_api_key_here insert_token_here xxxxxxxxxxxxxxxx test_secret_value
information international university government development responsibility communication representation
"""


class Novelty:
    """Bytes that a run adds after its surroundings, for each of its characters."""

    def __init__(self) -> None:
        made = zstandard.ZstdCompressionDict(WORDS + IDENTIFIERS + CODE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=9, dict_data=made, write_checksum=False, write_content_size=False)

    def added(self, around: str, run: str) -> int:
        known = around.encode("utf-8", "replace")
        return len(self.press.compress(known + run.encode())) - len(self.press.compress(known))

    def __call__(self, before: str, run: str, after: str) -> float:
        around = f"{before}\n{after}\n"
        return min(self.added(around, run), self.added(around.lower(), run.lower())) / len(run)


def limit(run: str) -> float:
    """The novelty from which a run is reported."""
    low = run.lower()
    if HEXADECIMAL.fullmatch(low):
        letters = 10 if low.isdigit() else 16
    else:
        letters = sum(n for found, n in ALPHABETS if found.search(low))
    dense = DENSE * log2(letters) / 8
    return dense + (CUTOFF - dense) * min(1.0, LONG / len(run))


def fixed(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches."""
    out = []
    low = text.lower()
    if len(low) != len(text) or any(w in low for w in STARTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def sensitive(text: str) -> list[list[tuple[int, int]]]:
    """The runs in a sensitive context, in order; those that follow each other by lines together."""
    hints = [m.span() for m in HINTS.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    if not hints:
        return out
    starts = [s for s, _ in hints]
    for m in RUN.finditer(text):
        start, end = m.span()
        if out and WRAP.fullmatch(text, out[-1][-1][1], start):
            out[-1].append((start, end))
            continue
        # the last hint that starts before the run's first characters end
        i = bisect_left(starts, start + LEAST) - 1
        if i >= 0 and hints[i][1] >= start - NEAR:
            out.append([(start, end)])
    return out


def novel(text: str, taken: list[tuple[int, int, int]], measure: Novelty) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the runs that are new against their surroundings."""
    out: list[tuple[int, int, int]] = []
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end) - 1
        return i < 0 or reach[i] <= start

    for lines in sensitive(text):
        lines = [x for x in lines if free(*x)]
        whole = len(lines) > 1 and told(text, lines[0][0], "".join(text[s:e] for s, e in lines), lines[-1][1], measure)
        out += [(s, 3, e) for s, e in lines if whole or told(text, s, text[s:e], e, measure)]
    return out


def told(text: str, start: int, run: str, end: int, measure: Novelty) -> bool:
    return measure(text[max(0, start - BEFORE) : start], run, text[end : end + AFTER]) >= limit(run)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str, measure: Novelty) -> list[tuple[int, int, int]]:
    base = fixed(text)
    return sorted(base + novel(text, base, measure))


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, digest of the fixed spans, and all spans of every row."""

    def make():
        measure = Novelty()

        def one(raw: bytes) -> tuple:
            text = raw.decode("utf-8", "replace")
            base = fixed(text)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            return (*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + novel(text, base, measure))))

        return one

    return common.map_text(documents, SCHEMA, make)
