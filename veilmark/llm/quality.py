"""Problem 3: per-document text statistics.

Method: each stretch of a text (a line, or a few sentences of one) is described by the share of its tokens that are
function words of a language, other words, numbers and signs. That distribution is held against structural profiles
(prose in each language, list, table, code, noise) by Jensen-Shannon divergence, and the stretch belongs to the nearest.
Scripts without spaces are cut into characters, particles and short runs. In a text that hardly has function words of any
listed language, a stretch that is built like a sentence (an end mark, several words, in scripts with letter case a
capital and then mostly small letters) is described by its word lengths instead: short words take the place of function
words. A text is natural prose when at least half of its characters stand in prose stretches. Basic counts are built-in
Spark expressions; nothing is shuffled before the few findings are made distinct.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import records, whole_records
from veilmark.llm.textform import caseless

# Frequent function words of some languages, without case.
FUNCTION_WORDS = {
    "english": "the of and a an to in is it its was were be been are that this these those which who whom whose what where when why how not no nor but or if so as at by for from with without within on onto into over under up down out off near next between behind below above after before until while because although though than then there here he she they we you i me him her them us his their our your my mine one some any each every all most more many few much both either neither other another only also too again never always often can could may might must shall should will would do does did has have had just very please once about",
    "french": "le la les un une des du de et est sont être avoir que qui quoi dans pour par pas ne plus avec sans sur sous ce cette ces il elle ils elles nous vous je tu on son sa ses leur leurs mais ou où donc car comme très aussi après avant déjà au aux en se si tout tous avons avez ont fait peut",
    "german": "der die das den dem des ein eine einer eines einem einen und ist sind war waren nicht kein keine mit von zu zum zur im in an am auf aus bei nach über unter für durch gegen ohne um als wie wenn weil dass daß ob aber oder auch noch nur schon sehr so er sie es wir ihr ich du sein ihre seine wird werden hat haben hatte",
    "spanish": "el la los las un una unos unas de del al y e o u es son era fue ser estar que quien cual como cuando donde porque pero si no más muy con sin por para en sobre entre hasta desde su sus mi tu se lo le les nos ya también todo todos esta este esto hay ha han aquí después antes tenemos tiene nosotros ahora así otro otra",
    "italian": "il lo la i gli le un una uno di del della dei delle da dal in nel nella con su sul per tra fra e o ma se che chi cui non più come quando dove perché anche sono è era essere avere ha hanno si ci ne al alla ai",
    "portuguese": "o a os as um uma de do da dos das em no na nos nas por para com sem sobre e ou mas se que quem como quando onde porque não mais muito também já é são foi era ser estar tem há seu sua ao à pelo pela",
    "dutch": "de het een en van in op te dat die is was zijn niet met voor aan er om door over uit bij naar als maar ook nog of dan wat wie waar hoe hij zij wij ik je we ze hun haar mijn zo al worden werd heeft hebben had",
    "polish": "i w z na do nie się jest są był była było to ten ta te tego co jak że czy ale lub oraz dla po od przez pod nad przed przy bez on ona ono my wy oni jego jej ich już tylko też bardzo o a za",
    "russian": "и в не на с что как это он она они мы вы я ты его её ее их к ко у о об от до за из по под над при без для но а или если то же бы был была было были быть есть так уже только ещё еще все всё кто где когда который чтобы после",
    "greek": "ο η το οι τα του της των τον την τους τις και να θα δεν μη είναι ήταν με σε για από προς που πως τι ως αλλά ή αν στο στη στην στον στα μια ένα ένας αυτό αυτή αυτός μου σου μας σας",
    "turkish": "ve bir bu şu o da de ile için gibi kadar daha en çok ne var yok mi mı değil ama ya veya ben sen biz siz onlar olan olarak her hiç",
    "danish": "og i at det er en et den til på af for med de der ikke som var jeg har han hun vi kan skal vil fra eller om så men ud op over efter ved blev havde sin sit sine når meget være mod også",
    "norwegian": "og i å det er en et den til på av for med de som ikke var jeg har han hun vi kan skal vil fra eller om så men ut opp over etter ved ble hadde sin sitt sine når mye være mot også",
    "finnish": "ja on ei se että oli hän ne joka jotka mutta kun niin kuin myös ovat olivat ole hänen sen tai jos vain nyt sitten tämä tässä siitä kanssa mukaan jälkeen ennen koska vielä jo minä sinä me te he mitä kuka missä vanhan oma hyvin ollut sekä eivät en",
    "hungarian": "a az és hogy nem is egy ez volt de meg csak már mint ha van vagy el ki még azt ezt aki ami amely minden között után előtt mert így úgy nagyon lehet lesz voltak sem én te ő mi ti ők be le fel itt ott akkor amikor majd saját",
    "romanian": "și în de la cu pe nu un o este sunt a al ai ale că să din care mai pentru lui lor se era au fost sau dar ce cum când unde prin după până fără între despre acest această aceasta acea foarte tot toate noi voi ei ele el ea am ai fi fie",
    "czech": "a v na se je že s z do to o k i ve pro za by ale jako po jeho tak od už při která které který když nebo jsem jsme jsou byl byla bylo byli až než pod před mezi bez jen také ještě si mu jí ho co kde kdo ten ta ty této",
    "slovak": "a v na sa je že s z do to o k aj vo pre za by ale ako po jeho tak od už pri ktorá ktoré ktorý keď alebo som sme sú bol bola bolo boli až než pod pred medzi bez len tiež ešte si mu jej ho čo kde kto ten tá tie",
    "croatian": "i u je na se da su za od s iz koji koja koje kao ne to ali ili što sam smo bio bila bilo bili nije do po o pri bez nakon prije već samo još kad kada gdje ako jer ovaj taj tu njegov njezin više vrlo te",
    "indonesian": "yang dan di ke dari ini itu untuk dengan pada adalah tidak akan dalam oleh sebagai juga atau saya kami kita dia mereka anda ada bisa telah sudah lebih karena jika ketika saat tetapi namun hanya para sebuah seorang bahwa secara setiap hari sangat belum masih lagi pun agar seperti antara",
    "vietnamese": "và của là có không được các những một trong cho với này đó đã sẽ đang từ đến ở tại trên dưới người ra vào về khi nếu thì mà nhưng hay hoặc rất cũng như để bởi vì do theo sau trước tôi chúng anh chị em ông bà họ nó mình lại còn chỉ nhiều ngày",
    "ukrainian": "і й в у не на що з та як це він вона вони ми ви я ти його її їх до по за від із під над при без для але або якщо то ж би був була було були бути є так вже тільки ще все хто де коли який яка які щоб після про",
    "arabic": "في من على إلى عن مع هذا هذه ذلك تلك التي الذي الذين أن إن كان كانت يكون لا ما لم لن قد أو ثم كل بعد قبل بين هو هي هم نحن أنا كما حتى عند عندما منذ غير بعض أي إذا لكن حيث أيضا فيها فيه عليه عليها له لها به بها وفي ومن وكان وكانت وقد وهو وهي وهذا وهذه ولا",
    "persian": "و در به از که این را با است برای آن یک خود تا بر هم نیز بود شد شده می ما او من شما آنها ها یا اما اگر هر چه پس پیش روی زیر بین بی نه باید کرد کرده دارد داشت هستند",
    "hebrew": "של את על לא הוא היא זה זאת עם כל גם אם או כי אל מה מי הם אני אנחנו אתה היה היתה היו יש אין רק עוד כמו אבל אחרי לפני בין כאשר שלא אשר לו לה להם זו כך",
    "hindi": "है हैं का की के को में से पर और यह वह ने था थी थे नहीं भी एक हो कि जो तो लिए इस उस ये वे कर गया गई साथ अपने अपनी अपना बाद तक या हम आप मैं उन इन कुछ सब बहुत जब तब होता होती",
    "bengali": "এবং ও এই সে তার আমি আমরা তুমি আপনি তারা একটি এক যে কি না হয় ছিল ছিলেন করে করা জন্য থেকে সঙ্গে পর আগে কিন্তু বা যদি তবে সব কোন আর তা",
    "tamil": "ஒரு இது அது என்று மற்றும் அவர் அவன் அவள் நான் நாம் நீ இல்லை உள்ள என்ன எந்த இந்த அந்த ஆனால் பின்னர் முன் வரை மிகவும் தான்",
    "korean": "은 는 이 가 을 를 에 의 도 로 와 과 에서 으로 까지 부터 그 이 저 것 수 더 또 및 한 들",
    "chinese": "的 了 是 在 不 我 有 他 这 這 那 和 也 就 都 说 說 要 会 會 对 對 着 著 与 與 及 为 為 所 以 于 於 上 中 下 们 們 你 她 它 个 個 之 而 到 从 從 被 把 让 讓 很 没 沒 还 還 又 再 里 裡 其 或 但 因 得 地 过 過 能 可 一",
    "japanese": "の は を に が と で も た て し な い る れ ら か ま す だ や こ そ あ へ り",
    "thai": "ที่ และ ใน ของ เป็น ได้ ไม่ มี ว่า จะ การ ให้ นี้ กับ แล้ว ก็ มา ไป อยู่ จาก โดย หรือ แต่ เขา เธอ เรา ผม ฉัน คน ความ ซึ่ง เพื่อ ถ้า เมื่อ ต้อง กว่า ทุก",
    "swedish": "och i att det som en ett på är av för med till den de inte om har var han hon vi jag du men eller så från vid kan ska när hur då under över efter",
}
#: Profiles: shares of function words, other words, numbers, signs. Prose profiles hold for every language above.
PROFILES = {
    "prose": (0.42, 0.42, 0.02, 0.14),
    "short prose": (0.26, 0.58, 0.02, 0.14),
    "list": (0.01, 0.84, 0.02, 0.13),
    "sheet": (0.01, 0.62, 0.09, 0.28),
    "table": (0.01, 0.35, 0.34, 0.30),
    "code": (0.01, 0.36, 0.07, 0.56),
    "noise": (0.01, 0.14, 0.15, 0.70),
}
PROSE = ("prose", "short prose")
PROSE_SHARE, RATIO_TOLERANCE = 0.5, 0.001
#: Words of a stretch: sentences of a line are put together up to the first, runs without sentences cut at the second.
STRETCH_WORDS, WINDOW_WORDS = 12, 24
#: A text whose blocks of so many words hold less than this share of distinct ones repeats itself and is no prose.
REPEAT_BLOCK, REPEAT_SHARE = 200, 0.15

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,:]\d+)*|[^\w\s]|_")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)]*\s+")
#: Texts with such characters take the wide tokens: marks belong to their letters; Han and kana stand alone, Korean
#: particles and Thai function words are cut from what they lean on, other Thai in short runs.
_WIDE_SCRIPT = re.compile("[\u0590-\u10ff\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af]")
_KOREAN, _THAI = (sorted(FUNCTION_WORDS[_l].split(), key=len, reverse=True) for _l in ("korean", "thai"))
_WIDE_TOKEN = regex.compile(
    rf"[\p{{Han}}\p{{Hiragana}}]|\p{{Katakana}}+|[가-힣]+?(?=(?:{'|'.join(_KOREAN)})?(?![가-힣]))|(?:{'|'.join(_KOREAN)})(?![가-힣])"
    rf"|{'|'.join(_THAI)}|(?:(?!{'|'.join(_THAI)})[\u0e00-\u0e7f]){{1,5}}|[\p{{L}}\p{{M}}--\u0e00-\u0e7f]+(?:['’-][\p{{L}}\p{{M}}]+)*|\d+(?:[.,:]\d+)*|[^\w\s]|_",
    regex.V1,
)
#: What ends a sentence in some script.
_STOPS = ".!?…。！？।؟۔။။។"
#: Under this share of function words in its best language a text counts as of no listed language. Such a stretch needs so
#: many words to be a sentence; up to the second many letters are a short word in it.
UNLISTED_SHARE, SENTENCE_WORDS, SHORT_LETTERS = 0.15, 5, 4
#: Vowels of the Latin, Greek and Cyrillic alphabets (decomposed), and their least share of a sentence's letters there.
_ALPHABETS, _VOWELS, VOWEL_SHARE = re.compile("[a-zα-ωа-яєіїґ]"), frozenset("aeiouyıæøœəαεηιουωаеиоуыэюяєіїё"), 0.25
LANGUAGES = list(FUNCTION_WORDS)
_WORD_LANGUAGES: dict[str, list[int]] = {}
for _k, _l in enumerate(LANGUAGES):
    for _w in FUNCTION_WORDS[_l].split():
        _WORD_LANGUAGES.setdefault(caseless(_w), []).append(_k)
_LANGUAGE_WORDS = [frozenset(map(caseless, _l.split())) for _l in FUNCTION_WORDS.values()]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (base 2) of each row of p against each row of q."""
    a, b = p[:, None, :] + 1e-12, q[None, :, :] + 1e-12
    m = (a + b) / 2
    return ((a * np.log2(a / m)).sum(2) + (b * np.log2(b / m)).sum(2)) / 2


def stretches(text: str) -> Iterator[str]:
    """Lines, long ones as groups of sentences, those without sentences as windows of words."""
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        if len(line) <= 120:
            yield line
            continue
        held: list[str] = []
        n = 0
        for sentence in _SENTENCE.split(line):
            words = sentence.split(" ")
            if len(words) > 2 * WINDOW_WORDS:
                for k in range(0, len(words), WINDOW_WORDS):
                    yield " ".join(words[k : k + WINDOW_WORDS])
                continue
            held.append(sentence)
            n += len(words)
            if n >= STRETCH_WORDS:
                yield " ".join(held)
                held, n = [], 0
        if held:
            yield " ".join(held)


def like_sentence(stretch: str, own: list[str]) -> bool:
    """Built like a sentence: words enough, an end mark, and where there is letter case a capital and then mostly small
    letters; in alphabets with vowels, vowels enough."""
    if len(own) < SENTENCE_WORDS or stretch.rstrip("\"”»)’' ")[-1:] not in _STOPS:
        return False
    letters = [c for c in stretch if c.isalpha()]
    cased = [c for c in letters if c.lower() != c.upper() and not "\u10a0" <= c <= "\u10ff"]  # Georgian is written in small letters
    if len(cased) >= len(letters) / 2 and (cased[0].islower() or 10 * sum(c.isupper() for c in cased) > 2 * len(cased)):
        return False
    plain = [c for c in unicodedata.normalize("NFD", "".join(own)) if c.isalpha()]
    alphabetic = sum(map(bool, map(_ALPHABETS.match, plain)))
    return alphabetic < len(plain) / 2 or sum(c in _VOWELS for c in plain) >= VOWEL_SHARE * alphabetic


def describe(texts: list[str | None]) -> dict[str, list]:
    """Statistics of each text: words, mean word length, shares of symbols, of lines ending in punctuation and of
    function words, the nearest structural profile, the divergence from prose and the share of characters in prose."""
    owner: list[int] = []
    sizes: list[int] = []
    rows: list[tuple] = []
    basics = []
    for k, text in enumerate(texts):
        parts = []
        letters = lines = stopped = 0
        by = [0] * len(LANGUAGES)
        words: list[str] = []
        token = _WIDE_TOKEN if text and _WIDE_SCRIPT.search(text) else _TOKEN
        for stretch in stretches(text) if text else ():
            tokens = token.findall(caseless(stretch))
            own = [t for t in tokens if t[0].isalpha()]
            for t in own:
                for x in _WORD_LANGUAGES.get(t, ()):
                    by[x] += 1
            numbers = sum(t[0].isdecimal() for t in tokens)
            parts.append((own, numbers, len(tokens) - len(own) - numbers, sum(map(len, tokens)), stretch))
            words += own
            lines += 1
            stopped += stretch[-1] in _STOPS or stretch[-1] in "\"”»"
        common = _LANGUAGE_WORDS[by.index(max(by))]
        distinct = sum(len(set(words[j : j + REPEAT_BLOCK])) for j in range(0, len(words), REPEAT_BLOCK))
        repeats = len(words) > 40 and distinct < REPEAT_SHARE * len(words)
        symbols = 0
        unlisted = max(by) < UNLISTED_SHARE * len(words)
        for own, numbers, signs, size, stretch in parts:
            if repeats:
                f = 0
            else:
                f = sum(t in common for t in own)
                if unlisted and like_sentence(stretch, own):
                    f = max(f, sum(len(t) <= SHORT_LETTERS for t in own))
            total = len(own) + numbers + signs
            symbols += signs
            if total:
                owner.append(k)
                sizes.append(size)
                rows.append((f / total, (len(own) - f) / total, numbers / total, signs / total))
        letters = sum(map(len, words))
        w = len(words)
        basics.append((w, letters / w if w else 0.0, symbols / max(1, len(text or "")), stopped / lines if lines else 0.0, max(by) / w if w else 0.0))
    n = len(texts)
    shares = np.array(rows, float).reshape(-1, 4)
    apart = divergence(shares, np.array(list(PROFILES.values())))
    nearest = apart.argmin(1) if len(rows) else np.zeros(0, int)
    chars = np.zeros((n, len(PROFILES)))
    far = np.zeros(n)
    np.add.at(chars, (np.array(owner, int), nearest), np.array(sizes, float))
    np.add.at(far, np.array(owner, int), np.array(sizes, float) * apart[:, : len(PROSE)].min(1) if len(rows) else 0.0)
    total = chars.sum(1)
    prose = chars[:, : len(PROSE)].sum(1)
    names = list(PROFILES)
    columns = list(zip(*basics)) if basics else [[]] * 5
    return {
        "word_count": list(columns[0]),
        "mean_word_length": list(columns[1]),
        "symbol_ratio": list(columns[2]),
        "stopped_lines": list(columns[3]),
        "function_words": list(columns[4]),
        "profile": [names[j] if t else "empty" for j, t in zip(chars.argmax(1), total)],
        "prose_divergence": [float(f / t) if t else 1.0 for f, t in zip(far, total)],
        "prose_share": [float(p / t) if t else 0.0 for p, t in zip(prose, total)],
    }


_STATISTICS = "word_count bigint, mean_word_length double, symbol_ratio double, stopped_lines double, function_words double, profile string, prose_divergence double, prose_share double"


def text_statistics(df: DataFrame) -> DataFrame:
    """df's columns source_record_index, text with the statistics of each text, row by row.

    A null text has null statistics; an empty or blank text has profile ``empty`` and no prose.
    """
    out = pa.schema([("source_record_index", pa.int64())] + [(c.split()[0], {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]]) for c in _STATISTICS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = describe(texts)
            columns = [pa.array([None if t is None else v for t, v in zip(texts, found[f.name])], f.type) for f in list(out)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=out)

    return df.select("source_record_index", "text").mapInArrow(run, "source_record_index bigint, " + _STATISTICS)


def contradicted() -> Column:
    """Whether a stored statistic that is not null contradicts the text that is not null."""
    text = F.col("text")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    ascii_letters = F.length(F.regexp_replace(text, r"[^A-Za-z]+", ""))
    ratio = F.when(letters == 0, F.lit(0.0)).otherwise(F.try_divide(ascii_letters, letters))
    wrong = (
        F.coalesce(F.col("char_count") != F.length(text), F.lit(False))
        | F.coalesce(F.col("byte_count") != F.octet_length(text), F.lit(False))
        | F.coalesce(F.isnan("ascii_letter_ratio") | (F.abs(F.col("ascii_letter_ratio") - ratio) > RATIO_TOLERANCE + 1e-12), F.lit(False))
    )
    return text.isNotNull() & wrong


def findings(df: DataFrame) -> DataFrame:
    """(source_record_index, finding): ``not_prose`` and ``wrong_stats``; each once however often a row is repeated."""
    rows = df.where("source_record_index IS NOT NULL AND text IS NOT NULL")
    wrong = rows.where(contradicted()).select("source_record_index", F.lit("wrong_stats").alias("finding"))
    junk = text_statistics(rows).where(F.col("prose_share") < PROSE_SHARE).select("source_record_index", F.lit("not_prose").alias("finding"))
    return junk.unionByName(wrong).distinct()


def doubtful_texts(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found."""
    return findings(records(spark, folder, "text", "char_count", "byte_count", "ascii_letter_ratio"))


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """p3_statistics: the statistics of every record with a text."""
    return text_statistics(whole_records(spark, folder, "text").where("text IS NOT NULL"))
