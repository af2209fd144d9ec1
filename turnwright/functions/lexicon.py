"""Words of Hindi and Marathi written forms.

Fixed values: number words, scales, months and cues of the two languages, one entry a line or a list.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    lang: str
    numbers: dict[int, tuple[str, ...]]
    hundred: tuple[str, ...]  # behind a number word with a space; empty where hundreds are one word
    hundred_heads: dict[str, int]  # whole words for 100 to 900
    compound_hundred: tuple[str, ...]
    thousand: tuple[str, ...]
    lakh: tuple[str, ...]
    crore: tuple[str, ...]
    arab: tuple[str, ...]
    quarter_more: tuple[str, ...]
    one_and_half: tuple[str, ...]
    two_and_half: tuple[str, ...]
    half_more: tuple[str, ...]
    quarter_less: tuple[str, ...]
    point: tuple[str, ...]
    percent: tuple[str, ...]
    months: dict[int, tuple[str, ...]]
    oclock: tuple[str, ...]
    past: tuple[str, ...]
    minute: tuple[str, ...]
    morning: tuple[str, ...]
    later: tuple[str, ...]

    def values(self, low: int = 0, high: int = 99) -> dict[str, int]:
        return {w: n for n, words in self.numbers.items() if low <= n <= high for w in words}

    def word(self, n: int) -> str:
        return self.numbers[n][0]


def _numbers(text: str) -> dict[int, tuple[str, ...]]:
    return {int(line.split()[0]): tuple(line.split()[1:]) for line in text.strip().splitlines()}


#: Fixed values.
HI_NUMBERS = _numbers("""
0 शून्य
1 एक वन वान
2 दो टू टु
3 तीन थ्री
4 चार फोर फॉर
5 पाँच पांच फाइव फाईव
6 छह छः सिक्स
7 सात सेवन
8 आठ एट ऐट
9 नौ नाइन
10 दस टेन
11 ग्यारह
12 बारह
13 तेरह
14 चौदह
15 पंद्रह पन्द्रह
16 सोलह
17 सत्रह
18 अट्ठारह अठारह
19 उन्नीस
20 बीस
21 इक्कीस
22 बाईस
23 तेईस
24 चौबीस
25 पच्चीस
26 छब्बीस
27 सत्ताईस
28 अट्ठाईस
29 उनतीस
30 तीस
31 इकतीस
32 बत्तीस
33 तैंतीस
34 चौंतीस
35 पैंतीस
36 छत्तीस
37 सैंतीस
38 अड़तीस
39 उनतालीस
40 चालीस
41 इकतालीस
42 बयालीस
43 तैंतालीस
44 चौंतालीस
45 पैंतालीस
46 छियालीस
47 सैंतालीस
48 अड़तालीस
49 उनचास
50 पचास
51 इक्यावन
52 बावन
53 तिरेपन
54 चौवन
55 पचपन
56 छप्पन
57 सत्तावन
58 अट्ठावन
59 उनसठ
60 साठ
61 इकसठ
62 बासठ
63 तिरेसठ
64 चौंसठ
65 पैंसठ
66 छयासठ
67 सरसठ
68 अड़सठ
69 उनहत्तर
70 सत्तर
71 इकहत्तर
72 बहत्तर
73 तिहत्तर
74 चौहत्तर
75 पचहत्तर
76 छिहत्तर
77 सतहत्तर
78 अठहत्तर
79 उन्यासी
80 अस्सी
81 इक्यासी
82 बयासी
83 तिरासी
84 चौरासी
85 पचासी
86 छियासी
87 सत्तासी
88 अठासी
89 नवासी
90 नब्बे
91 इक्यानवे
92 बानवे
93 तिरानवे
94 चौरानवे
95 पचानवे
96 छियानवे
97 सत्तानवे
98 अट्ठानवे
99 निन्यानवे
""")

#: Fixed values.
MR_NUMBERS = _numbers("""
0 शून्य
1 एक
2 दोन
3 तीन
4 चार
5 पाच
6 सहा
7 सात
8 आठ
9 नऊ नउ
10 दहा
11 अकरा
12 बारा
13 तेरा
14 चौदा
15 पंधरा
16 सोळा
17 सतरा
18 अठरा
19 एकोणीस एकोणिस
20 वीस विस
21 एकवीस एकविस
22 बावीस बाविस
23 तेवीस तेविस
24 चोवीस चोविस
25 पंचवीस पंचविस
26 सव्वीस सब्बीस
27 सत्तावीस सत्ताविस
28 अठ्ठावीस अठ्ठाविस
29 एकोणतीस
30 तीस
31 एकतीस एकत्तीस
32 बत्तीस
33 तेहतीस तेहेतीस
34 चौतीस
35 पस्तीस पंचतीस
36 छत्तीस
37 सदतीस सदोतीस
38 अडतीस
39 एकोणचाळीस
40 चाळीस
41 एक्केचाळीस एकेचाळीस
42 बेचाळीस
43 त्रेचाळीस
44 चव्वेचाळीस चौवेचाळीस
45 पंचेचाळीस
46 सेहेचाळीस शेचाळीस
47 सत्तेचाळीस
48 अठ्ठेचाळीस
49 एकोणपन्नास
50 पन्नास
51 एक्कावन्न
52 बावन्न
53 त्रेपन्न
54 चोपन्न चौपन्न
55 पंचावन्न
56 छप्पन्न
57 सत्तावन्न
58 अठ्ठावन्न
59 एकोणसाठ
60 साठ
61 एकसष्ठ एक्साष्ठ
62 बासष्ठ
63 त्रेसष्ठ
64 चौसष्ठ
65 पासष्ठ
66 सहासष्ठ
67 सदुसष्ठ
68 अडुसष्ठ
69 एकोणसत्तर
70 सत्तर
71 एकाहत्तर
72 बाहत्तर
73 त्र्याहत्तर त्र्याह्त्तर
74 चौर्‍याहत्तर चौऱ्याहत्तर
75 पंचाहत्तर
76 शाहत्तर
77 सत्त्याहत्तर
78 अठ्ठ्याहत्तर
79 एकोण्यांशी एकोणऐंशी
80 ऐंशी एंशी
81 एक्क्याऐंशी एक्याऐंशी
82 ब्याऐंशी
83 त्र्याऐंशी
84 चौऱ्याऐंशी चौर्‍याऐंशी
85 पंच्याऐंशी पंचाऐंशी
86 शहाऐंशी
87 सत्त्याऐंशी
88 अठ्ठ्याऐंशी
89 एकोणनव्वद
90 नव्वद
91 एक्क्याण्णव एक्याण्णव
92 ब्याण्णव
93 त्र्याण्णव
94 चौऱ्याण्णव चौर्‍याण्णव
95 पंच्याण्णव पंचाण्णव
96 शहाण्णव
97 सत्त्याण्णव
98 अठ्ठ्याण्णव
99 नव्व्याण्णव नव्याण्णव
""")

#: Native month names; English names are added in three letter cases.
HI_MONTHS = ("जनवरी", "फरवरी फ़रवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर सितम्बर", "अक्टूबर", "नवंबर नवम्बर", "दिसंबर दिसम्बर")
MR_MONTHS = ("जानेवारी", "फेब्रुवारी फेब्रवारी", "मार्च", "एप्रिल", "मे", "जून", "जुलै जुलाई", "ऑगस्ट ऑगस्ट", "सप्टेंबर सप्टेम्बर", "ऑक्टोबर ऑक्टोंबर", "नोव्हेंबर नोव्हेम्बर", "डिसेंबर डिसेम्बर")
EN_MONTHS = ("January Jan", "February Feb", "March Mar", "April Apr", "May", "June Jun", "July Jul", "August Aug", "September Sep Sept", "October Oct", "November Nov", "December Dec")


def _months(native: tuple[str, ...]) -> dict[int, tuple[str, ...]]:
    return {m: tuple(dict.fromkeys([*own.split(), *(form for w in en.split() for form in (w, w.upper(), w.lower()))])) for m, (own, en) in enumerate(zip(native, EN_MONTHS, strict=True), 1)}


HI = Lexicon(
    "hi", HI_NUMBERS, ("सौ", "हंड्रेड", "हन्ड्रेड"), {}, ("सौ", "हंड्रेड", "हन्ड्रेड"),
    ("हज़ार", "हजार", "थाउजेंड", "थाउजंड", "थाउज़ेंड", "थाउज़ंड"), ("लाख",), ("करोड़", "करोड"), ("अरब",),
    ("सवा",), ("डेढ़", "डेढ"), ("ढाई",), ("साढ़े", "साढे"), ("पौने",), ("दशमलव",), ("प्रतिशत", "फीसदी", "फ़ीसदी"),
    _months(HI_MONTHS), ("बजे",), ("बजकर",), ("मिनट",), ("सुबह",), ("दोपहर", "शाम", "रात"),
)
MR = Lexicon(
    "mr", MR_NUMBERS, (), {"शंभर": 1} | {f"{w}शे": n for n in range(1, 10) for w in MR_NUMBERS[n]}, ("शंभर",),
    ("हजार", "हज़ार"), ("लाख",), ("कोटी", "करोड", "करोड़"), ("अब्ज", "अरब"),
    ("सव्वा", "सवा"), ("दीड", "डीड"), ("अडीच", "अडिच"), ("साडे", "साढे"), ("पावणे", "पाउणे", "पाउने"), ("दशांश", "दशमलव"), ("टक्के", "टक्का", "प्रतिशत"),
    _months(MR_MONTHS), ("वाजता",), ("वाजून",), ("मिनिटे", "मिनिट", "मिनिटं"), ("सकाळी",), ("दुपारी", "संध्याकाळी", "रात्री"),
)
LEXICONS = {"hi": HI, "mr": MR}

#: Fixed values.
RUPEES = ("रुपये", "रुपया", "रू")
PAISE = ("पैसे", "पैसा")
RUPEE_SIGNS = ("₹", "Rs.", "Rs", "rs.", "rs", "RS.", "RS", "INR", "inr")
AM = ("AM", "am", "A.M.", "a.m.")
PM = ("PM", "pm", "P.M.", "p.m.")
