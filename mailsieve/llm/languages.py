"""Languages of documents and of their paragraphs by error-correcting output codes.

Each language has a codeword of 15 bits; a binary classifier over character n-grams predicts each bit, and the
language whose codeword costs the least logistic loss against the 15 real-valued predictions wins (loss-weighted
decoding). A document whose two best codewords are nearly equally cheap is flagged as ambiguous.

Fitting takes the seed texts below and a bounded sample of labelled rows. Labels may be wrong, so a first model is
fitted on the seeds alone, and later ones on those sampled paragraphs to whose label the model before gave a chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import some_rows, spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "hi", "hi-latn")
#: Labelled rows read for fitting, at most.
SAMPLE = 1_200
#: Hashed n-gram features.
WIDTH = 1 << 13
#: The least probability that confirms a sampled paragraph's label; a wrong one has less than a thousandth.
CONFIRMED = 0.05
#: A document is ambiguous if its best codeword beats the second by less than this confidence.
AMBIGUOUS = 0.2

# Notations of the languages' names: ISO 639-1, 639-2 and English; a region or script may follow a code.
NOTATIONS = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian", "pt": "pt por portuguese",
    "it": "it ita italian", "nl": "nl nld dut dutch flemish", "hi": "hi hin hindi", "hi-latn": "hinglish",
}
# Labels that name no language.
NO_LABEL = "und unknown none null na n/a xx mis mul zxx ?? - unk undefined undetermined other".split()

SEEDS = {
    "en": """The weather was cold this morning and we walked to the station because there was no bus. She has written three letters and would like to know whether you can come. It is not easy to find the right answer when nobody asks the question. They were going to buy bread and milk for the whole family, but the shop had already closed. Please tell your brother that his keys are on the table in the kitchen. I have never seen so many people there before. Which of these books should we read first? You can change your mind at any time. Your message will be sent to those who are on the list.""",
    "de": """Das Wetter war heute Morgen kalt und wir gingen zu Fuß zum Bahnhof, weil kein Bus fuhr. Sie hat drei Briefe geschrieben und möchte wissen, ob du kommen kannst. Es ist nicht leicht, die richtige Antwort zu finden, wenn niemand die Frage stellt. Sie wollten Brot und Milch für die ganze Familie kaufen, aber der Laden war schon zu. Bitte sagen Sie Ihrem Bruder, dass seine Schlüssel auf dem Tisch in der Küche liegen. Ich habe dort noch nie so viele Leute gesehen. Welches dieser Bücher sollen wir zuerst lesen? Sie können Ihre Meinung jederzeit ändern. Ihre Nachricht wird an alle auf der Liste geschickt.""",
    "fr": """Il faisait froid ce matin et nous avons marché jusqu'à la gare parce qu'il n'y avait pas de bus. Elle a écrit trois lettres et voudrait savoir si vous pouvez venir. Ce n'est pas facile de trouver la bonne réponse quand personne ne pose la question. Ils allaient acheter du pain et du lait pour toute la famille, mais le magasin était déjà fermé. Dites à votre frère que ses clés sont sur la table de la cuisine. Je n'ai jamais vu autant de gens là-bas. Lequel de ces livres devons-nous lire d'abord ? Vous pouvez changer d'avis à tout moment. Votre message sera envoyé à ceux qui sont sur la liste.""",
    "es": """Hacía frío esta mañana y caminamos hasta la estación porque no había autobús. Ella ha escrito tres cartas y quiere saber si puedes venir. No es fácil encontrar la respuesta correcta cuando nadie hace la pregunta. Iban a comprar pan y leche para toda la familia, pero la tienda ya estaba cerrada. Dile a tu hermano que sus llaves están en la mesa de la cocina. Nunca he visto tanta gente allí. ¿Cuál de estos libros debemos leer primero? Puedes cambiar de opinión en cualquier momento. Tu mensaje se enviará a los que están en la lista.""",
    "pt": """Estava frio esta manhã e fomos a pé até a estação porque não havia ônibus. Ela escreveu três cartas e quer saber se você pode vir. Não é fácil encontrar a resposta certa quando ninguém faz a pergunta. Eles iam comprar pão e leite para toda a família, mas a loja já estava fechada. Diga ao seu irmão que as chaves dele estão na mesa da cozinha. Nunca vi tantas pessoas lá. Qual destes livros devemos ler primeiro? Pode mudar de opinião a qualquer momento. A sua mensagem será enviada às pessoas que estão na lista.""",
    "it": """Faceva freddo questa mattina e siamo andati a piedi alla stazione perché non c'era l'autobus. Lei ha scritto tre lettere e vorrebbe sapere se puoi venire. Non è facile trovare la risposta giusta quando nessuno fa la domanda. Volevano comprare il pane e il latte per tutta la famiglia, ma il negozio era già chiuso. Di' a tuo fratello che le sue chiavi sono sul tavolo della cucina. Non ho mai visto così tante persone lì. Quale di questi libri dobbiamo leggere per primo? Puoi cambiare idea quando vuoi. Il tuo messaggio sarà inviato a chi è nella lista.""",
    "nl": """Het was koud vanochtend en we liepen naar het station omdat er geen bus reed. Zij heeft drie brieven geschreven en wil weten of je kunt komen. Het is niet makkelijk om het juiste antwoord te vinden als niemand de vraag stelt. Ze wilden brood en melk kopen voor het hele gezin, maar de winkel was al dicht. Zeg tegen uw broer dat zijn sleutels op de tafel in de keuken liggen. Ik heb daar nog nooit zoveel mensen gezien. Welk van deze boeken moeten wij eerst lezen? U kunt altijd van gedachten veranderen. Uw bericht wordt verstuurd naar iedereen die op de lijst staat.""",
    "hi": """आज सुबह ठंड थी और हम पैदल स्टेशन गए क्योंकि बस नहीं थी। उसने तीन पत्र लिखे हैं और जानना चाहती है कि क्या आप आ सकते हैं। जब कोई सवाल नहीं पूछता तो सही जवाब ढूँढना आसान नहीं होता। वे पूरे परिवार के लिए रोटी और दूध खरीदने वाले थे, लेकिन दुकान बंद हो चुकी थी। अपने भाई से कहिए कि उसकी चाबियाँ रसोई की मेज़ पर हैं। मैंने वहाँ इतने लोग पहले कभी नहीं देखे। इनमें से कौन सी किताब हमें पहले पढ़नी चाहिए? आप कभी भी अपना विचार बदल सकते हैं।""",
    "hi-latn": """Aaj subah thand thi aur hum paidal station gaye kyunki bus nahi thi. Usne teen chitthiyan likhi hain aur jaanna chahti hai ki kya aap aa sakte hain. Jab koi sawaal nahi poochta to sahi jawaab dhoondhna aasaan nahi hota. Ve poore parivaar ke liye roti aur doodh khareedne wale the, lekin dukaan band ho chuki thi. Apne bhai se kahiye ki uski chaabiyan rasoi ki mez par hain. Maine wahan itne log pehle kabhi nahi dekhe. Inme se kaun si kitaab humein pehle padhni chahiye? Aap kabhi bhi apna vichaar badal sakte hain. Aapka sandesh un sab ko bheja jayega jo is list mein hain.""",
}

#: Codewords: rows 1 to 9 of the 16 x 16 Hadamard matrix without its constant column; any two differ in 8 bits.
CODES = np.array([[1 - 2 * (bin(i & j).count("1") & 1) for j in range(1, 16)] for i in range(1, len(LANGUAGES) + 1)], np.float32)

_paragraph = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_noise = re.compile(r"\S*(?:[@/]\S|\w\.\w)\S*|[\d_]+|[^\S ]+")


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs of a text, separated by empty lines; none for a null or blank text."""
    return [x for x in _paragraph.split(text.strip()) if x.strip()] if text else []


def declared_language(label: Column) -> Column:
    """The language that a label names in any notation, in the codes of LANGUAGES; a language outside them by its
    own lower-cased name; null for an absent, empty or meaningless label."""
    tidy = F.lower(F.trim(label))
    tag = F.regexp_replace(tidy, "_", "-")
    out = F.when(tag.rlike(r"^(hi|hin|hindi)\W*latn?\b|^(hi|hin|hindi)\W+(latin|roman)"), "hi-latn")
    for language, names in NOTATIONS.items():
        out = out.when(F.split(tag, r"[-\s(]")[0].isin(names.split()), language)
    return out.when(tidy.isNull() | ~tidy.rlike(r"[\p{L}]") | tidy.isin(NO_LABEL), None).otherwise(tidy)


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all uni-, bi- and trigrams, three to a character, and where each text starts."""
    padded = [f" {' '.join(_noise.sub(' ', x.lower()).split())} " for x in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    mix = c * np.uint32(2654435761)
    mix ^= mix >> np.uint32(15)
    b = np.zeros_like(mix)
    b[1:] = mix[:-1]
    b = b * np.uint32(2246822507) + mix
    t = np.zeros_like(mix)
    t[2:] = mix[:-2] * np.uint32(3266489909)
    t = t + b * np.uint32(668265263) + np.uint32(12345)
    fold = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(8)) & np.uint32(WIDTH - 1)
    return np.stack([fold(mix), fold(b + np.uint32(99)), fold(t)], 1).astype(np.int32), np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class Model:
    """Weights of the 15 binary classifiers; a fixed 8192 x 15 floats however much it was fitted on."""

    weights: np.ndarray
    bias: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the index of its language and the probabilities of all languages."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros((0, len(LANGUAGES)))
        bits = np.empty((len(texts), CODES.shape[1]), np.float32)
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            hashed, starts = _hashes(part)
            total = np.add.reduceat(self.weights[hashed[:, 0]] + self.weights[hashed[:, 1]] + self.weights[hashed[:, 2]], starts)
            bits[at : at + len(part)] = total / np.diff(np.append(starts, len(hashed)))[:, None] + self.bias
        loss = np.logaddexp(0, -bits[:, None, :] * CODES[None]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), p / p.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], steps: int = 60) -> Model:
    """Logistic regression for each bit of the codewords, by Adam over all texts at once."""
    hashed, starts = _hashes(texts)
    sizes = np.diff(np.append(starts, len(hashed)))
    x = np.zeros((len(texts), WIDTH), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(texts)), 3 * sizes), hashed.ravel()), 1)
    x /= sizes[:, None]
    y = CODES[[LANGUAGES.index(k) for k in labels]]
    share = np.array([1 / labels.count(k) for k in labels], np.float32)[:, None]  # every language weighs the same
    share /= share.sum()
    w, b = np.zeros((WIDTH, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    mean = [np.zeros_like(w), np.zeros_like(b)]
    square = [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        pull = -y / (1 + np.exp(y * (x @ w + b))) * share
        for k, (parameter, gradient) in enumerate(((w, x.T @ pull + 1e-7 * w), (b, pull.sum(0)))):
            mean[k] = 0.9 * mean[k] + 0.1 * gradient
            square[k] = 0.98 * square[k] + 0.02 * gradient**2
            parameter -= 1.0 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.98**step)) + 1e-6)
    return Model(w, b)


def fit_on(df: DataFrame, text: str, label: str, sample: int = SAMPLE) -> Model:
    """Fits on the seeds and on at most ``sample`` rows of df whose label names a known language, chosen by hash."""
    seeds = [(s.strip(), k) for k, v in SEEDS.items() for s in re.split(r"(?<=[.?!।])\s+", v)]
    seeds += [(" ".join(s for s, k in seeds if k == language), language) for language in LANGUAGES]
    rows = df.select(F.col(text).alias("t"), declared_language(F.col(label)).alias("k")).where(F.col("k").isin(*LANGUAGES) & (F.length("t") > 0))
    picked = some_rows(rows, sample)
    listed = [(p, r.k) for r in picked for p in paragraphs(r.t)]
    model = fit(*map(list, zip(*seeds)))
    if not listed:
        return model
    for _ in range(2):  # a better model confirms more of the true labels
        _, chance = model.score([p for p, _ in listed])
        sure = [x for x, c in zip(listed, chance) if c[LANGUAGES.index(x[1])] >= CONFIRMED]
        model = fit(*map(list, zip(*(seeds + sure))))
    return model


def document_languages(df: DataFrame, keys: list[str], text: str, label: str, model: Model | None = None) -> DataFrame:
    """Per record one row with seg_no 0 for the whole, and one for each paragraph, counted from 1: the keys, seg_no,
    lang, confidence (0 to 1), ambiguous, and ``declared``, the language that the record's label names.

    A null or blank text gives one row with seg_no 0, null lang and confidence 0. The whole's language is that of
    most of its characters, its confidence their share weighted by the paragraphs' confidence. Null keys and repeated
    rows are kept. Without a model, one is fitted on a sample of df."""
    model = model or fit_on(df, text, label)
    kinds = [(k, df.schema[k].dataType.simpleString()) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [paragraphs(t) for t in batch["_text"]]
            best, chance = model.score([p for ps in split for p in ps])
            order = np.sort(chance, 1)
            at, rows, segments, langs, sure, flags = 0, [], [], [], [], []
            for row, ps in enumerate(split):
                mass = np.zeros(len(LANGUAGES))
                here = range(at, at + len(ps))
                for p, k in zip(ps, here):
                    mass[best[k]] += len(p) * chance[k, best[k]]
                total = sum(map(len, ps))
                top = int(mass.argmax())
                rows += [row] * (len(ps) + 1)
                segments += [0, *range(1, len(ps) + 1)]
                langs += [LANGUAGES[top] if ps else None, *(LANGUAGES[best[k]] for k in here)]
                sure += [mass[top] / total if ps else 0.0, *(chance[k, best[k]] for k in here)]
                second = np.sort(mass)[-2] / total if ps else 0.0
                flags += [not ps or mass[top] / total - second < AMBIGUOUS, *(order[k, -1] - order[k, -2] < AMBIGUOUS for k in here)]
                at += len(ps)
            out = batch.drop(columns="_text").iloc[rows].reset_index(drop=True)
            yield out.assign(seg_no=segments, lang=langs, confidence=sure, ambiguous=flags)

    rows = spread(df.select(*keys, declared_language(F.col(label)).alias("declared"), F.col(text).alias("_text")))
    return rows.mapInPandas(run, ", ".join(f"`{k}` {t}" for k, t in kinds) + ", declared string, seg_no int, lang string, confidence double, ambiguous boolean")
