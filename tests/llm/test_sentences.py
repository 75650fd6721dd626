import random
import time

import pytest
import regex
from rows import rows

from tallyloom.llm import sentence_rules as R
from tallyloom.llm import sentences as S
from tallyloom.llm.sentence_rules import MARKS
from tallyloom.llm.sentences import sentence_ends, split_sentences


def cut(text):
    begin, out = 0, []
    for end in sentence_ends(text):
        out.append(text[begin:end].strip())
        begin = end
    return out


# one string for each text, sentences separated by the sign |
CASES = """
It fell.| It grew!| Who won?
He left on Jan. 50, 1715.| Dr. Metu came at 6 a.m. and left at 9.| When it fell, Mr. Gake wept.
At 5 p.m. Funu counted it.| It opened at 5 p.m.| And it closed.
The U.S. style map is at www.a.example/b.html now.| See file a.txt and vol. 3, p. 36, cf. Zazul et al. for it.
It belongs to Rako Ltd.| It is old.| Rako Ltd. kept it.| They sold maps, bells, etc.| They sold bells, etc. here.
J. R. Grymer was born to A. Zolo.| Was it Vale Jr. who fell?| In the 1st ed. it is old.| It has 5 sq. km. of land.
It won 68–3.| It cost $ 49.4 at No. 39 Tefo Road.| Is it 59.02, 18.07 or .5?| So it is.
The tower... well, it arrived.| Perhaps...| The end.| Why (and how?) Zade won is unknown.| Only one (i.e. this one) fell (see Fig. 31.) today.
“Go. Take it. Run,” said Zade.| “Who won?” asked Zade.| “Zade! Vale!” the crown cried.| ‘Is it old?’ I asked.| The play “Sepum!” closed.
Zade wrote: “It fell. It slept.”| Then it rose.| Zade said, “It fell.”| “It sang,” said Zade, “and how.”| "Hold it!" cried Zade, and it fell.
(It slept all night.)| [Aside] It fell.| It waited [citation needed].[66]| What?!| No!!!| It moved! 🎉| It stayed.
It fell before dawn.|Vale saw it.| So it fell!|Then it rose.
it fell again.| going there now.| ok.| Zade won.| stone mine law!! |who saw it?
Am 3. Mai 1236 kam der 2. Dienst bzw. der 3. Markt.| Vgl. Bd. 2, S. 55, zum Hof.| Es gab z. B. Turm, d. h. Hof, usw.| Der sog. Wald…, ja, er fiel.| Zade fragte: „Wer kam?“| „Er kam“, sagte Zade.
M. Zapa vint p. ex. en 1771, voir t. 2, p. 3, n. 4.| «\xa0Partons\xa0! Il vient\xa0», cria Zade.| Quel pont\xa0!| Le pont… disons qu’il tomba.
El Sr. Nylir y la Dra. Zodor, p. ej., vieron la pág. 17 del vol. 2.| ¡Qué día!| ¿Y él? —preguntó Zade.| Mide 34,4 km.| ¿Quién vino?
Это было в 1999 г. в Неро, т. е. давно.| В 1999 г.| Им. Вело назван лес на ул. Ведра.| См. стр. 35 и рис. 2.| — Где он? — спросил Веро.| А. С. Веро пел.| Там были сады и т. д.| Ну… сад пел.
Ποιος ήρθε;| Ο κ. Λοτα είδε π.χ. το 1874 τον τόπο· ο τόπος έχει 41,5 χλμ. και 20 μ. περίπου.| «Πού είναι;» ρώτησε ο Λορο.
زار د. كاكا القصر.| ص. 49 من ج. 2 عن النهر.| «أين البرج؟» سأل زيزي.| قال كالو: «البرج هنا. هيا بنا!»| ما أجمل البرج!
ڈاکٹر نے کہا، “باغ یہاں ہے۔ چلو!”| لمبائی 48.3 ہے۔
डॉ. तामी आया।| लंबाई 45.67 कि.मी. है।| “नदी कहाँ है?” लोलो ने पूछा।| उसने कहा, “बाग आया। चलो!”| अंत हुआ॥
“花园在哪里？”维诺问道。|维诺说：“高塔来了。我们走吧！”|「船只。」|他用 Ver.2.0 看见了《山记》第3.2节。|真的吗？！|那座……也许好。|（他来了。）
「川はどこだ？」とルルは言った。|ミカルは「船が来た。逃げよう」と叫んだ。|Dr.ザネは来た。|え？！
1821년에 왕을 보았다!| 네카가 “강이 왔다. 가자!” 하고 말했다.| “정원은 어디에 있소?”라고 물었다.| 길이는 16.3 km이다.
1347 թ. Տավելո եկավ։| «Այգի է», ասաց Կակա։| Ո՞վ եկավ։
ርዝመቱ 87.2 ኪ.ሜ. ነው።| ማን ረሳ?| ዶ/ር ካሎ ከፈተ።
မြင်သည်။|ရှိ 21.6 မိုင်ကို ဆောက်သည်။
ใครพบเมือง| มี 13 คนในเมือง| ในปี พ.ศ. 1223 เวโลมา| เขาใช้ Mapper สร้างเมือง
1. Who won?| 2. It fell.
""".strip().split("\n")


@pytest.mark.parametrize("case", CASES)
def test_languages(case):
    expected = [p.strip() for p in case.split("|")]
    if case.startswith("1. Who"):
        assert cut(expected[0] + "\n\n" + expected[1]) == expected
    else:
        assert cut(case.replace("|", "")) == expected


@pytest.mark.parametrize("case", ["XII. Who won?", "xvi. The king came.| It fell.", "(XIV. Who won?", "XXXVIII. It fell.", "स्व. राम आया।", "स्व. राम आया।| कुल 5 कि.मी. है।"])
def test_long_numerals_and_abbreviations(case):
    assert cut(case.replace("|", "")) == [p.strip() for p in case.split("|")]
    assert cut("It fell.\n" + case.replace("|", "")) == ["It fell.", *(p.strip() for p in case.split("|"))]


@pytest.mark.parametrize(
    "case",
    [
        "“नदी कहाँ है?” " + "लोलो " * 40 + "ने पूछा।| अंत हुआ।",
        "“باغ کہاں ہے؟” " + "لولو " * 40 + "نے پوچھا۔| لمبائی 48.3 ہے۔",
        "“花园在哪里？”" + "维诺" * 40 + "问道。|高塔来了。",
        "“花园在哪里？”" + "维诺" * 20 + "Ver.2……" + "维诺" * 20 + "问道。|高塔来了。",
        "“नदी कहाँ है?”| लोलो आया।| लोलो ने पूछा।",
        "“花园在哪里？”|高塔来了。|维诺问道。",
    ],
)
def test_speakers_of_any_length(case):
    assert cut(case.replace("|", "")) == [p.strip() for p in case.split("|")]


def test_many_quotations_take_linear_time():
    for quotation in ("«It fell.» ", "«Πού;» ", "«It fell…» ", "«It fell।» "):
        begin = time.process_time()
        sentence_ends(quotation * 20000)
        assert time.process_time() - begin < 20


@pytest.mark.parametrize(
    "case",
    [
        "བོད་ཡིག།| དེ་རིང་། །| ང་འགྲོ།",
        "ᠮᠣᠩᠭᠣᠯ᠃| ᠪᠢᠴᠢᠭ᠉| ᠮᠣᠩ᠃",
        "ܫܠܡܐ܁| ܥܠܡܐ܀",
        "ᐃᓄᒃ᙮| ᐃᓄᐃᑦ᙮",
        "ភាសា៕| ខ្មែរ។",
        "ꦗꦮ꧉| ꦧꦱ꧉",
        "𑄌𑄋𑄴𑅁| 𑄌𑄇𑄴𑅃",
        "It fell\u2024| It cost 4\u20245 km\ufe52| Zade won‽| Who",
        "မြင်သည်၊ ရှိသည်။|မြင်သည်။",
    ],
)
def test_marks_of_other_scripts(case):
    assert cut(case.replace("|", "")) == [p.strip() for p in case.split("|")]


def test_all_sentence_terminals():
    missing = [c for c in map(chr, range(0x110000)) if regex.match(r"\p{Sentence_Terminal}", c) and c not in MARKS]
    assert missing == ["\u104a"]


def test_units_and_positions():
    text = " \tAct 1, Scene 2 \r\n\r\nLet it fall, and\nlet it be.  Yes\n \n\n🎉\n"
    assert [text[:e].splitlines()[-1][-4:] for e in sentence_ends(text)] == ["ne 2", " be.", " Yes", "🎉"]
    assert sentence_ends("a\u2029b") == [1, 3]
    for line_end in ("\n", "\r\n", "\r"):
        assert len(sentence_ends(f"One line{line_end}and another. Next.")) == 2
        assert len(sentence_ends(f"Heading{line_end} {line_end}It is{line_end}one.{line_end}{line_end}")) == 2
    for blank in (None, "", " \n\n\t", " "):
        assert sentence_ends(blank) == []
    assert sentence_ends("x") == [1]


def test_long_texts_take_linear_time():
    text = "It fell (once “again. " * 20000
    assert len(sentence_ends(text)) >= 1
    assert len(sentence_ends("It fell. " * 50000)) == 50000
    assert len(sentence_ends("x" * 10**6 + ".")) == 1
    assert len(sentence_ends("!" * 10**6)) == 1


GROWING = {
    "numbers": "12.5 7.25 ",
    "list numbers": "3. 4! 5? ",
    "dots": ". ",
    "quoted dots": '"." ',
    "closing signs": ".”)",
    "capitals": "A.",
    "initials": "A. ",
    "Indic letters": "क.",
    "titles": "Mr. ",
    "table": "| 1.5 | 2.5 | 3.5! |\n",
    "notes": "[1]",
    "emoji": "🎉. ",
    "Thai": "ก.",
    "quotations": "“a!”b",
    "nested": '("«a. b.»." )',
    "apostrophes": "’b",
    "abbreviations": "z. B. ",
    "mixed": "It fell (at 5.5, “so!”) in 1. Nr. 7 «etc.» …3 ",
}


@pytest.mark.parametrize("name", GROWING)
def test_time_grows_with_the_text(name):
    """Twice the text takes about twice the time."""

    def seconds(size):
        text = "Word. ‘x “" + GROWING[name] * (size // len(GROWING[name]))
        begin = time.process_time()
        sentence_ends(text)
        return time.process_time() - begin

    half, whole = min(seconds(100_000) for _ in range(2)), min(seconds(200_000) for _ in range(2))
    assert whole < 5 and whole < 2.4 * half + 0.2


def test_a_megabyte_of_numbers():
    begin = time.process_time()
    sentence_ends("Word " + "12.5 7.25 3. 4! " * 65536)
    assert time.process_time() - begin < 20


@pytest.mark.parametrize("blanks", [" ", "\u00a0"])
def test_long_blanks_and_dashes(blanks):
    begin = time.process_time()
    assert sentence_ends("It fell." + blanks * 10**6 + "It rose." + "-" * 10**6) == [8, 2 * 10**6 + 16]
    assert time.process_time() - begin < 20


@pytest.mark.parametrize(
    "case",
    [
        "He takes vitamin D.| It helps.",
        "Solve for c.| Then add p.| It works.",
        "He sold the firm to M.| Nobody cared.",
        "Plan S.| Nr. 5 gilt.",
        "It was built c. 1850 by M. Smith and D. Jones of the U.S. Army.",
        "Il vit M. Zapa et Me. Nolo.| El libro de D. Zapa y D. Nolo.",
        "It fell. Dr. Zade kam z. B. am 3. Mai.| Vgl. Bd. 2, S. 61, zum Garten.| It rose.".replace("fell. Dr", "fell.| Dr"),
        "Zade said, “It rose.”| It began again.| “It rose!” Zade remarked.| “Now!” He cried.",
        "He said: “It fell. It rose. Did it?” | Then he left.".replace(" | ", "| "),
        "Dr. med. Hans Metu wohnt in der Hofstr. 7.| Ludwig XIV. war König.| Es fiel auf -3.5 °C.| Es stieg.",
        "Kupo said, “It sang.”| Zade said, “It slept.”| “It fell.”| Vale wrote: “It rose.”| “It fell!” Vale cried.",
        "“It fell.| It rose.”| Then he left.| (It slept.| It woke.)| He wrote “It fell. It rose.”| Then he left.",
        'He said: "She said: “It fell. It rose.”"| Then he left.',
        "»Es fiel.« Er ging.| »Es fiel«, sagte er.| Er fragte: »Wer kam?«".replace("fiel.« Er", "fiel.«| Er"),
    ],
)
def test_language_of_the_sentence(case):
    assert cut(case.replace("|", "")) == [p.strip() for p in case.split("|")]


def test_plain_words_need_no_other_tables(monkeypatch):
    """The shortcut for ordinary words gives what all tables give."""
    draw = random.Random(4)
    listed = [w for kind in (R.TITLES, R.NUMBERED, R.INNER, R.ENDING) for words in kind.values() for w in words.split()]
    bits = [*listed, "xii", "VIII", "word", "Wort", "тоже", "λόγος", "said", "нет", "ኪሎ", "क", "ص", "U.S", "12", "a", "B", "e\u0301"]
    joins = [". ", ". ", ".", " ", ".\n", '." ', ". 5", ".) ", " (", "… "]
    texts = ["".join(draw.choice(bits) + draw.choice(joins) for _ in range(40)) for _ in range(1500)] + [c.replace("|", "") for c in CASES]
    short = [sentence_ends(t) for t in texts]
    monkeypatch.setattr(S, "is_plain", lambda last, script: False)
    assert short == [sentence_ends(t) for t in texts]


def test_rows(spark):
    data = [(1, "It fell. It rose.", "xx", "clash"), (2, None, None, "clash"), (3, "", "en", "clash"), (4, " ", "en", "clash"), (5, "It fell. It rose.", "th", "clash"), (None, "No id.", "en", "clash")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, k string")
    assert rows(split_sentences(df)) == [(1, 8), (1, 17), (5, 8), (5, 17), (None, 6)]
    assert rows(split_sentences(df.limit(0))) == []
