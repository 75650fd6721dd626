"""Sentences of natural prose, most of it classic and out of copyright, with ends marked by hand as |."""

from tallyloom.llm.sentences import sentence_ends

SAMPLE = """
It is a truth universally acknowledged, that a single man in possession of a good fortune, must be in want of a wife.| However little known the feelings or views of such a man may be on his first entering a neighbourhood, this truth is so well fixed in the minds of the surrounding families, that he is considered as the rightful property of some one or other of their daughters.| “My dear Mr. Bennet,” said his lady to him one day, “have you heard that Netherfield Park is let at last?”| Mr. Bennet replied that he had not.| “But it is,” returned she; “for Mrs. Long has just been here, and she told me all about it.”| Mr. Bennet made no answer.| “Do you not want to know who has taken it?” cried his wife impatiently.| “You want to tell me, and I have no objection to hearing it.”| This was invitation enough.
Call me Ishmael.| Some years ago—never mind how long precisely—having little or no money in my purse, I thought I would sail about a little and see the watery part of the world.| It is a way I have of driving off the spleen and regulating the circulation.
To Sherlock Holmes she is always the woman.| I have seldom heard him mention her under any other name.| “Wedlock suits you,” he remarked.| “I think, Watson, that you have put on seven and a half pounds since I saw you.”| “Seven!” I answered.| “Indeed, I should have thought a little more.| Just a trifle more, I fancy, Watson.”| The note was undated, and without either signature or address.| It was signed by Count Von Kramm.| The man who wrote it was presumably well to do, i.e. rich.
Marley was dead: to begin with.| There is no doubt whatever about that.| Old Marley was as dead as a door-nail.| Mind!| I don’t mean to say that I know, of my own knowledge, what there is particularly dead about a door-nail.| “Bah!” said Scrooge, “Humbug!”| “Christmas a humbug, uncle!” said Scrooge’s nephew.| “You don’t mean that, I am sure?”
The city lies at 3.5 km from the coast (approx. 2 mi) and had 12,450 inhabitants in 1901.| Its mayor, Dr. H. G. Wellford, was born on Sept. 4, 1850, in St. Albans.| He studied at Oxford from 1869 to 1873 etc.| The railway opened at 7 a.m. on 3 May 1862.| J. P. Morgan financed it.| See fig. 4 and p. 17 of the report by Smith et al. for details.| Version 2.1.4 runs on the U.S. network.| Is it safe?| Yes.
He takes vitamin D. |It helps.| Solve for c. |Then add p. |It works.| He sold the firm to M. |Nobody cared.| Blood type is A or B. |These are common.| We met Agent K. |He never spoke.| She lives in Washington, D.C., near the river.| George W. Bush met T. S. Eliot’s niece, Mrs. E. M. Forster.| They left the U.S. |Then they came back.
Als Gregor Samsa eines Morgens aus unruhigen Träumen erwachte, fand er sich in seinem Bett zu einem ungeheueren Ungeziefer verwandelt.| Er lag auf seinem panzerartig harten Rücken und sah, wenn er den Kopf ein wenig hob, seinen gewölbten, braunen Bauch.| »Was ist mit mir geschehen?«, dachte er.| Es war kein Traum.| Sein Zimmer lag ruhig zwischen den vier wohlbekannten Wänden.
Der Ort hat ca. 3.000 Einwohner und liegt z. B. näher an Köln als Bonn, d. h. weiter im Norden.| Am 12. Juli 1890 kam der 3. Zug an.| Vgl. S. 14 ff. und Bd. 2 des Werks.| Prof. Dr. Karl Meier, geb. 1870, war dort bis 1901 Lehrer usw.| Plan S. |Nr. 5 gilt.| Wann kam er?| Um 8 Uhr!
Longtemps, je me suis couché de bonne heure.| Parfois, à peine ma bougie éteinte, mes yeux se fermaient si vite que je n’avais pas le temps de me dire : « Je m’endors. »| Nous étions à l’étude, quand le proviseur entra, suivi d’un nouveau habillé en bourgeois.| M. Roger nous fit signe de nous rasseoir.| « Levez-vous », dit le professeur.| Il se leva ; sa casquette tomba.| Toute la classe se mit à rire.| Qui était-ce ?| Mme Bovary, née Dubuc, habitait au no. 12 de la rue Saint-Jean, p. ex. en hiver.
En un lugar de la Mancha, de cuyo nombre no quiero acordarme, no ha mucho tiempo que vivía un hidalgo de los de lanza en astillero.| Frisaba la edad de nuestro hidalgo con los cincuenta años.| ¿Quién era el Sr. Quijada?| El Dr. García nació en 1850 a. C. según la pág. 12, p. ej., del vol. 3 de la obra.| ¡Qué disparate!| Nadie lo creyó.
Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.| Все смешалось в доме Облонских.| Жена узнала, что муж был в связи с бывшею в их доме француженкою-гувернанткой.| Он родился в 1828 г. в Ясной Поляне, т. е. под Тулой.| Л. Н. Толстой умер в 1910 г. |Его книги читают и т. д. |Где же он?
道可道，非常道。|名可名，非常名。|子曰：“学而时习之，不亦说乎？有朋自远方来，不亦乐乎？”|他走了！
吾輩は猫である。|名前はまだ無い。|どこで生れたかとんと見当がつかぬ。|「何だ？」と彼は言った。
It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness.| There were a king with a large jaw and a queen with a plain face, on the throne of England.| It was the year of Our Lord one thousand seven hundred and seventy-five.| Mrs. Southcott had recently attained her five-and-twentieth blessed birthday.
Alice was beginning to get very tired of sitting by her sister on the bank.| “And what is the use of a book,” thought Alice, “without pictures or conversations?”| Suddenly a White Rabbit with pink eyes ran close by her.| “Oh dear! Oh dear! I shall be late!” it said to itself.| Down, down, down.| Would the fall never come to an end?| “I wonder how many miles I’ve fallen by this time?” she said aloud.
Dr. Jekyll lived at No. 14, St. James St., London W.C., with Mr. Poole.| On Oct. 18 he met Col. Moran at 9:30 a.m. sharp.| The meeting cost him approx. £3.50.| He wrote to J. R. R. Tolkien and C. S. Lewis.| Their firm, Smith & Sons Inc., went bankrupt in 1931.| Temperatures fell to -3.5 °C.| See Sec. 2.3, pp. 10–12, and cf. Fig. 7 below.| The E.U. and the U.K. signed it.| What happened next?| Nobody knows!
The experiment used vitamin C. |Subjects received 5 mg. per day.| Type II errors rose (p < 0.05).| Visit www.example.org or write to a.b@example.com for more.| The file is called report.final.pdf.| He got an A. |She got a B.
Es war einmal ein kleines süßes Mädchen, das hatte jedermann lieb.| Einmal schenkte sie ihm ein Käppchen von rotem Samt.| „Komm, Rotkäppchen“, sagte die Mutter, „da hast du ein Stück Kuchen.“| „Guten Tag, Rotkäppchen!“ sprach er.| „Wo hinaus so früh?“| Dr. med. Hans Bauer, geb. am 4. März 1901, wohnte in der Bahnhofstr. 7.| Das kostete ca. 3,50 Mark, d. h. fast nichts.| Ludwig XIV. war König von Frankreich.| Er kam am 1. Mai an.
Aujourd’hui, maman est morte.| Ou peut-être hier, je ne sais pas.| J’ai reçu un télégramme de l’asile.| « Mère décédée. Enterrement demain. Sentiments distingués. »| Cela ne veut rien dire.| M. Dupont et Mme. Durand habitent av. Foch, à env. 3 km de Paris.| « Où allez-vous ? » demanda-t-il.| Voltaire (1694–1778), cf. t. 3, p. 22, l’a écrit.
Muchos años después, frente al pelotón de fusilamiento, el coronel había de recordar aquella tarde.| El mundo era tan reciente que muchas cosas carecían de nombre.| —¿Quién es? —preguntó la Sra. Gómez.| —Soy yo.| Vive en la Avda. de Mayo, núm. 12, 3.º piso.| Nació el 3 de enero de 1901 en EE. UU. y murió allí.
В начале июля, в чрезвычайно жаркое время, под вечер, один молодой человек вышел из своей каморки.| Он благополучно избегнул встречи с своею хозяйкой на лестнице.| — Кто там? — спросил он.| — Это я, — ответил А. П. Чехов.| Дом стоял на ул. Ленина, д. 5, кв. 12.| В XIX в. город вырос и т. д. |Население — 12 тыс. человек.
""".strip().split("\n")


def marked(paragraph: str) -> tuple[str, set[int]]:
    text, ends = "", set()
    for piece in paragraph.split("|"):
        text += piece
        ends.add(len(text.rstrip()))
    return text, ends


def test_natural_prose():
    found = expected = both = 0
    wrong = []
    for paragraph in SAMPLE:
        text, ends = marked(paragraph)
        got = set(sentence_ends(text))
        found, expected, both = found + len(got), expected + len(ends), both + len(got & ends)
        wrong += [(text[max(0, e - 30) : e], text[e : e + 20], e in got) for e in got ^ ends]
    assert both / expected >= 0.98 and both / found >= 0.98, (both, expected, found, wrong)
