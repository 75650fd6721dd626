"""Segmentation rules: ordered pairs of what stands before and after a place, by language.

A place is where a mark that can end a sentence has been read, with the closing quotes, brackets, note numbers and emoji behind it. The tables of
its script and of the language of its sentence are asked in order, and in each the rules in order; the first that matches decides: BREAK or KEEP.
Where the language cannot be told, the tables of all languages of the script are asked.

No expression that looks back reaches beyond the word, number or run of signs at its place, so that a text of any kind takes linear time.
"""

from __future__ import annotations

BREAK, KEEP = True, False

# Abbreviations and words of each language, in natural order.

#: A name follows.
TITLES = {
    "english": "Mr Mrs Ms Messrs Dr Prof St Ste Gen Col Maj Capt Cpt Lt Sgt Cpl Adm Cmdr Gov Sen Rep Pres Rev Fr Hon Supt Insp Mt Ft",
    "german": "Hr Hrn Fr Frl Dipl Ing Prof Dr med phil jur rer nat St",
    "french": "M MM Mme Mmes Mlle Mlles Mgr Me Pr Dr St Ste",
    "spanish": "Sr Sra Srta Sres Sras Dr Dra D Dña Avda Ud Uds Prof Profa Ing Lic Gral Cap Sto Sta",
    "russian": "им Им ул г Г пр пл пер проф Проф акад Акад ген Ген полк Полк тов Тов гр Гр св Св",
    "greek": "κ Κ κκ κα δρ Δρ καθ Καθ αγ Αγ",
    "hindi": "डॉ श्री प्रो पं",
}
#: A number follows; before anything else they end a sentence like any word.
NUMBERED = {
    "english": "No Nos no nos Fig Figs fig figs vol Vol vols p P pp Pp ch Ch sec Sec eq Eq art Art par Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec ver Ver v c",
    "german": "Nr Abb Bd Bde S Kap Tab Abs Jh Str",
    "french": "t n p pp no fig chap art",
    "spanish": "pág págs Pág núm cap fig vol",
    "russian": "стр рис табл гл ч ст т с д кв",
    "greek": "σ σελ αρ τ",
}
#: The sentence always goes on.
INNER = {
    "english": "e.g i.e cf Cf ca approx vs viz resp incl esp",
    "german": "z.B Z.B d.h D.h u.a U.a z.T z.Z u.U i.d.R v.a s.o s.u m.E sog Sog bzw Bzw vgl Vgl ca evtl ggf inkl geb gest Hrsg hrsg",
    "french": "p.ex P.ex cf env éd av bd boul",
    "spanish": "p.ej P.ej aprox av Av",
    "russian": "т.е т.к т.н тыс млн см См ср Ср напр",
    "greek": "π.χ δηλ βλ",
}
#: They end a sentence if a capital follows.
ENDING = {
    "english": "etc Inc Ltd Co Corp Bros Jr Esq al ff ed eds sq km cm mm ft in oz lb hr min sec a.m p.m A.M P.M Ph.D M.D B.A M.A",
    "german": "usw usf etc m km cm Jh u.s.w",
    "french": "etc km m",
    "spanish": "etc km m a.C d.C EE.UU",
    "russian": "т.д т.п др д п г гг в вв км м см руб коп",
    "greek": "κ.λπ κλπ κ.ά χλμ μ χιλ",
}
#: Frequent words that tell languages of one script from each other.
FREQUENT = {
    "english": "the of and to in is was he she it that his her with for as on at by they we you this these those be are were been have has had not "
    "but or from which who when then there their its i my your our what all would will if about into than them him out up so no one can could "
    "do did said very only after before while where why how because some any more most other such nobody nothing",
    "german": "der die das und ist war nicht ein eine einen einem einer eines des dem den mit von zu im in auf für als auch sich es er sie wir ihr "
    "ich an am bei nach aus wie dass daß hat haben hatte wird werden wurde noch nur über um sein seine seinen seiner aber oder wenn zum zur so "
    "vor durch bis sind kam gibt man wo wer was",
    "french": "le la les des et est dans un une du de au aux en il elle ils elles on nous vous je que qui ne pas plus pour par sur avec sont était "
    "se ce cette ces son sa ses leur mais ou où si comme tout fut à ont sans sous après avant puis",
    "spanish": "el la los las de del y en un una que es se no por con para su sus lo al como más pero fue era son le les ha este esta estos sobre "
    "entre cuando muy sin ya hay desde hasta también donde",
}
#: Words that open a sentence and are no name: a capital and a full stop before one of them is no initial.
OPENERS = {
    "english": "The This That These Those It Its He She They We You His Her Their My Our In On At But And Or So If As When While Where Then There Here "
    "Who What Which Why How Nobody Nothing Everybody Everyone Someone Somebody Some Many Most All Both Each Every Another Yet Still However Now After Before Because Since For From With Was Is Are Were Did Do Does Has Have Had Not No",
    "german": "Der Die Das Ein Eine Es Er Sie Wir Ihr Und Aber Oder Doch Dann Dort Hier Wenn Als Weil Da Im Am In Auf Bei Nach Vor Seit Niemand Jeder Alle Viele Wer Was Wie Warum",
    "french": "Il Elle Ils Elles On Nous Vous Je Ce Cette Ces Mais Et Puis Alors Ensuite Quand Où Dans Personne Chacun Tous",
    "spanish": "Él Ella Ellos Ellas Se Pero Y Entonces Luego Cuando Donde En Nadie Todos Este Esta Estos Fue Era Hay",
}

MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner"
GERMAN_BEFORE_ORDINALS = "der die das den dem des am vom zum zur im beim ab bis seit jeder jede jedes ein eine einem einer"
SAYING = (
    "said says asked asks cried cries replied replies answered whispered shouted called exclaimed added murmured muttered wondered thought laughed sighed wrote began "
    "continued demanded insisted repeated screamed yelled remarked declared inquired enquired interrupted"
)
#: They begin a sentence and say nothing.
NO_SPEAKERS = "It Its This That These Those There Here Then Now Still Yet So And But Or"
#: Code points of the other scripts' marks: the rest of Unicode's Sentence_Terminal, and the Tibetan shads. Without U+104A, a comma in Burmese.
OTHER_SCRIPTS = (
    "61D-61E 700-702 7F9 837 839 83D-83E F0D-F12 1368 166E 1735-1736 17D4-17D5 1803 1809 1944-1945 1AA8-1AAB 1B4E-1B4F 1B5A-1B5B "
    "1B5E-1B5F 1B7D-1B7F 1C3B-1C3C 1C7E-1C7F 203D 2CF9-2CFB 2E2E 2E3C 2E53-2E54 2E60-2E61 A4FF A60E-A60F A6F3 A6F7 A876-A877 A8CE-A8CF "
    "A92F A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB FE12 FE15-FE16 FE56-FE57 10A56-10A57 10F55-10F59 10F86-10F89 11047-11048 110BE-110C1 "
    "11141-11143 111C5-111C6 111CD 111DE-111DF 11238-11239 1123B-1123C 112A9 113D4-113D5 1144B-1144C 115C2-115C3 115C9-115D7 "
    "11641-11642 1173C-1173E 11944 11946 11A42-11A43 11A9B-11A9C 11C41-11C42 11EF7-11EF8 11F43-11F44 16A6E-16A6F 16AF5 16B37-16B38 "
    "16B44 16D6E-16D6F 16E98 1BC9F 1DA88"
)
#: Marks that end a sentence wherever they stand outside a quotation that goes on.
SURE = "。！？｡؟۔।॥።፧։။‼⁇⁈⁉\u037e" + "".join(chr(c) for r in OTHER_SCRIPTS.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1))
#: Other forms of the full stop, which end a sentence before a blank.
STOPS = "\u2024\ufe52"
MARKS = ".!?…．" + STOPS + SURE
SHADS = "\u0f0d-\u0f12"
#: A full stop inside a name, a number or an abbreviation.
DOT_INSIDE = r"|[.．]++(?=[\p{L}\p{N}])"


def _phrase(stops: str, more: str = "") -> str:
    """Up to the verb of saying: anything but sentence marks and ``stops``. A pause is none, nor what matches ``more``."""
    return rf"(?:[^{MARKS};{stops}]|(?<!\p{{Greek}}\p{{M}}*);|…++(?=\s*\p{{L}}){more})*?"


#: Who or what was said or asked stands behind a quotation in scripts without capitals.
SAYING_AFTER = (
    r"(?:[^\s.!?؟،“”«»\"]+\s+)?(?:سأل|قال|صاح|أجاب|همس|صرخ|هتف|سألت|قالت|صاحت|أجابت)\b(?![^.!?؟\n]{0,40}:)",  # Arabic
    rf"{_phrase('“”')}(?:पूछा|कहा|बोला|बोली|चिल्लाया|चिल्लाई|उत्तर दिया)(?!\s*[,:])",  # Hindi
    rf"{_phrase('“”')}(?:پوچھا|کہا|بولا|بولی|چلایا)(?!\s*[،,:])",  # Urdu
    rf"{_phrase('；“”「」', DOT_INSIDE)}(?:问道|問道|说道|說道|说|說|喊道|叫道|答道|回答|笑道|写道|寫道)(?=[。，；！？])",  # Chinese
    r"(?:と|って|という|との)",  # Japanese
    r"\s?(?:라고|이라고|하고|고|라며|이라며|라는|하며)",  # Korean
)

CAPITAL = r"[\p{Lu}\p{Lt}]"
OPENING = r"[“”\"«»‹„‚‘'(\[（「『《【¿¡—–-]"
CLOSING = "”’'»›)\\]）］」』》〉】}"
#: They close only what they have opened: German and straight quotation marks.
CLOSING_IF_OPENED = "“\"«"
EMOJI = r"[\p{Extended_Pictographic}\u200d\ufe0f\U0001F3FB-\U0001F3FF\U0001F1E6-\U0001F1FF]"
#: Further marks, and the characters of the signs, between a mark and its place. One set, since looking back over repeated groups is slow.
BEHIND = rf"[{MARKS}]*[{CLOSING}{CLOSING_IF_OPENED}\[\p{{N}}\s{EMOJI[1:-1]}]*"
BEFORE_CAPITAL = rf"\s++(?:{OPENING}++\s*+)?{CAPITAL}"
#: One capital before a full stop.
INITIAL = r"(?<![\p{L}\p{M}\p{N}'’°])(?!I\.)\p{Lu}\."


def _any(words: list[str]) -> str:
    # parts of an abbreviation may be set apart by a blank: "z. B."
    return "|".join(w.replace(".", r"\.\s?") for w in sorted(dict.fromkeys(words), key=len, reverse=True))


def _abbreviations(language: str) -> list[tuple[bool, str, str, str]]:
    edge = r"(?<![\p{L}\p{M}\p{N}])"
    titles, numbered, inner, ending = (kind.get(language, "").split() for kind in (TITLES, NUMBERED, INNER, ENDING))
    rules = []
    if titles:
        rules.append((KEEP, ".", rf"{edge}(?:{_any(titles)})\.", r"\s*\p{L}"))
    if numbered:
        rules.append((KEEP, ".", rf"{edge}(?:{_any(numbered)})\.", r"\s*(?:[\p{N}§]|(?:[IVXLC]{2,}|[VX])\b)"))
    if inner:
        rules.append((KEEP, ".", rf"{edge}(?:{_any(inner)})\.", r"\s*\S"))
    for parts in (w.split(".") for w in dict.fromkeys(inner + ending) if "." in w):
        for k in range(1, len(parts)):
            rules.append((KEEP, ".", rf"{edge}{_any(['.'.join(parts[:k])])}\.", rf"\s?{_any(['.'.join(parts[k:])])}\."))
    if ending:
        rules.append((BREAK, ".", rf"{edge}(?:{_any(ending)})\.{BEHIND}", BEFORE_CAPITAL))
        rules.append((KEEP, ".", rf"{edge}(?:{_any(ending)})\.", r"\s*\p{Ll}"))
    if language in OPENERS:
        other = rf"|(?:{_any([w for w in numbered if len(w) > 1])})\." if numbered else ""
        rules.append((BREAK, ".", INITIAL, rf"\s+{OPENING}*(?:(?:{_any(OPENERS[language].split())})\b{other})"))
    return rules


#: Each rule: the decision, the marks it is about (none: all), what stands before its place, what behind it.
TABLES: dict[str, list[tuple[bool, str, str, str]]] = {
    "first": [
        (KEEP, STOPS, f"[{STOPS}]", r"\S"),
        (KEEP, ".", r"\.", r"[\p{Ll}\p{N}_/\\@]"),  # decimals, addresses, file names
        (KEEP, "", r"", r"\s*[,;:،؛，；：、]"),  # the sentence goes on
        (KEEP, "", r"", r"\s*+[—–-]++\s*+\p{Ll}"),  # who speaks, behind a dash
    ],
    "marks": [
        (BREAK, "!?", r"(?:!!|\?\?)", r"\s"),  # repeated marks end even an informal sentence
        (KEEP, ".…", rf"(?:\.\.+|…){BEHIND}", r"\s*(?:\p{Ll}|\p{Lo})"),  # a pause
        (KEEP, "!?", rf"[!?]{BEHIND}", r"\s*\p{Ll}"),  # a name with a mark
        (BREAK, ".!?…", rf"(?:[!?…]|\.\.+){BEHIND}", r""),
    ],
    "english": [
        (KEEP, ".", r"\b(?:At|By|Around|About|Before|After|Until|Since)\s+\p{N}{1,2}(?::\p{N}{2})?\s*[ap]\.\s?m\.", r"\s+\p{Lu}"),  # opens its sentence
        (KEEP, ".", r"(?<![\p{L}\p{M}'’])(?:\p{Lu}\.){2}", rf"\s+(?!(?:{_any(OPENERS['english'].split())})\b){CAPITAL}"),
        *_abbreviations("english"),
    ],
    "german": [
        (KEEP, ".", rf"(?i:\b(?:{GERMAN_BEFORE_ORDINALS.replace(' ', '|')}))\s+\p{{N}}{{1,3}}\.", r"\s+\p{Lu}"),
        (KEEP, ".", r"\b\p{Lu}\p{Ll}+\s[IVX]+\.", r"\s+\p{Ll}"),  # of kings and popes
        (KEEP, ".", r"\p{Ll}str\.", r"\s*\p{N}"),  # number of a house
        (KEEP, ".", r"\b\p{N}{1,2}\.", rf"\s+(?:{MONTHS.replace(' ', '|')})\b"),
        *_abbreviations("german"),
    ],
    "french": _abbreviations("french"),
    "spanish": _abbreviations("spanish"),
    "russian": [
        (BREAK, ".", r"\p{N}\s*(?:г|гг|в|вв)\.", BEFORE_CAPITAL),  # year and century, not town
        *_abbreviations("russian"),
    ],
    "greek": _abbreviations("greek"),
    "thai": [(KEEP, ".", r"\.", r"")],  # only abbreviations have one
    "armenian": [(KEEP, ".", r"\.", r"")],  # has a full stop of its own
    "arabic": [(KEEP, ".", r"(?<![\p{L}\p{M}])\p{Arabic}\.", r"\s*\S")],  # one letter is an abbreviation
    "indic": [(KEEP, ".", r"(?<![\p{L}\p{M}])[\p{L}\p{M}]{1,3}\.", r"\s*\S"), *_abbreviations("hindi")],
    "ethiopic": [(KEEP, ".", r"(?<![\p{L}\p{M}])[\p{L}\p{M}]{1,2}\.", r"\s*\S")],
    "numbers": [
        (KEEP, ".", r"(?:\A|\n)[^\S\n]*[\ufeff]?\(?(?:\p{N}{1,4}|\p{L}|[ivxIVX]+)\.", r"\s"),  # number of a list
    ],
    "initials": [
        (KEEP, ".", r"(?<![\p{L}\p{M}])[\p{L}\p{M}]{1,2}\.", r"\s*\p{Ll}"),  # short and unknown
        (KEEP, ".", r"\p{N}\.", r"\s*\p{Ll}"),
        (KEEP, ".", INITIAL, rf"\s*{CAPITAL}"),
    ],
    "last": [
        (BREAK, ".", rf"\.{BEHIND}", r"\s"),
        (BREAK, ".", rf"[\p{{L}}\p{{M}}\p{{N}})\]]\.{BEHIND}", rf"{OPENING}*+{CAPITAL}"),  # the blank is missing
        (KEEP, ".", rf"\.{BEHIND}", r""),
        (BREAK, "", r"", r""),
    ],
}

#: Tables for the script of the letter before the place, in the order in which they are asked; of those in ``LANGUAGES`` only
#: the one of the sentence's language, if that can be told.
CASCADES: dict[str, tuple[str, ...]] = {
    "latin": ("numbers", "first", "marks", "english", "german", "french", "spanish", "initials", "last"),
    "cyrillic": ("numbers", "first", "marks", "russian", "initials", "last"),
    "greek": ("numbers", "first", "marks", "greek", "initials", "last"),
    "thai": ("numbers", "first", "marks", "thai", "last"),
    "armenian": ("numbers", "first", "marks", "armenian", "initials", "last"),
    "arabic": ("numbers", "first", "marks", "arabic", "initials", "last"),
    "indic": ("numbers", "first", "marks", "indic", "initials", "last"),
    "ethiopic": ("numbers", "first", "marks", "ethiopic", "initials", "last"),
    "other": ("numbers", "first", "marks", "initials", "last"),
}

LANGUAGES = ("english", "german", "french", "spanish")
#: Tables that say something about a word of three letters or more before a full stop, unless it ends like a word of theirs.
ABOUT_EVERY_WORD = ("first", "marks", "last")
#: The last three letters of all abbreviations and Roman numerals: behind a word that ends otherwise, the tables of
#: ``ABOUT_EVERY_WORD`` decide alone.
SHORT_ENDS = {"str"} | {part[-3:] for kind in (TITLES, NUMBERED, INNER, ENDING) for words in kind.values() for w in words.split() for part in w.split(".")} | {
    a + b + c for a in "ivxIVX" for b in "ivxIVX" for c in "ivxIVX"
}
#: Scripts where a full stop behind any word can be no end, or whose abbreviations have three letters.
NEVER_PLAIN = ("thai", "armenian", "indic")

#: Scripts with neither full stop nor a mark of their own.
UNMARKED = r"\p{Thai}\p{Lao}"
