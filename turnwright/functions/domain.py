"""Domain terms: spellings of loan and lender names, and the form each is written in."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import FOUND, CompiledLexicon, Registry
from .spans import SPAN, span

#: Canonical form | its spellings, case does not matter.
TERMS = """
EMI | ई एम आई, इ एम आई, एम आई, ईएमआई, emi
CIBIL | सिबिल, सीबिल, सिविल
loan | लोन
payment | पेमेंट, पेमेन्ट
app | ऐप, एप
link | लिंक
UPI | यूपीआई, यू पी आई
PhonePe | फोन पे
Google Pay | गूगल पे
Paytm | पेटीएम
settlement | सेटलमेंट
foreclosure | फोरक्लोजर
NOC | एन ओ सी, एनओसी
Bajaj | बजाज, बाजाज, bajaj
Pulsar | पल्सर
good morning | गुड मॉर्निंग
good evening | गुड इवनिंग
good afternoon | गुड आफ्टरनून
penalty charges | पेनल्टी चार्जेस
penalty charge | पेनल्टी चार्ज
last date | लास्ट डेट
due date | ड्यू डेट, ड्यू डे
penalty | पेनल्टी
charges | चार्जेस
charge | चार्ज
auto | ऑटो
update | अपडेट
call | कॉल
phone | फ़ोन, फोन
line | लाइन
date | डेट
due | ड्यू
late | लेट
free | फ्री
OK | ओके
MoneyView | मनी व्यू, मनीव्यू, moneyview, money view
TVS | टीवीएस, टी वी एस
TVS Credit | टीवीएस क्रेडिट, टी वी एस क्रेडिट, tvs credit
IDFC FIRST Bank | आई डी एफ सी, आईडीएफसी, आई डी एफ सी फर्स्ट, idfc, idfc first
SMFG | एस एम एफ जी, एसएमएफजी
SMFG India Credit | एस एम एफ जी इंडिया क्रेडिट, एसएमएफजी इंडिया क्रेडिट, smfg india credit
HDFC Bank | एच डी एफ सी, एचडीएफसी, एच डी एफ सी बैंक, एचडीएफसी बैंक, hdfc, hdfc bank
HDB Financial Services | एच डी बी, एचडीबी, hdb finance, hdb financial
UGRO Capital | यू ग्रो कैपिटल, यूग्रो कैपिटल, उग्रो कैपिटल, ugro capital, ugro captial, u gro capital, u grow capital
KreditBee | क्रेडिटबी, क्रेडिट बी, kreditbee, kredit bee, creditbee, credit bee
Bajaj Finance | बाजाज फाइनेंस, बजाज फाइनेंस, bajaj finance
"""
RULE = "lex.domain.loan_terms.v1"


LEXICONS = Registry()


def term_table(terms: str = TERMS) -> dict[str, str]:
    return {s.strip().lower(): line.split("|")[0].strip() for line in terms.strip().splitlines() for s in line.split("|")[1].split(",")}


@cache
def compiled(terms: str = TERMS) -> CompiledLexicon:
    return CompiledLexicon((term, "domain_term", canonical) for term, canonical in term_table(terms).items())


LEXICONS.add("loan_terms", compiled)


def domain_terms(text: Column, terms: str = TERMS) -> Column:
    """Spans of terms, the longest first where they overlap, between characters that are not of words."""
    def one(m: Column) -> Column:
        return span(m["cls"], F.substr(text, m["start"] + 1, m["end"] - m["start"]), m["start"], m["end"], F.lit(RULE), 0.99, m["value"])

    return F.transform(F.coalesce(compiled(terms).found(text), F.array().cast(FOUND)), one).cast(f"array<{SPAN}>")
