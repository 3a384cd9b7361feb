"""Text cleaning, answer normalising and image-token formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.vectors import bind

# --- fixed values -----------------------------------------------------------------------------------------------------
BLANK_CHARS = " ;,[]{}'\".?:"
CLEAN_MARKS = '[.!"()*#:;~]'
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
CONTRACTIONS = {
    "aint": "ain't",
    "arent": "aren't",
    "cant": "can't",
    "couldve": "could've",
    "couldnt": "couldn't",
    "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've",
    "didnt": "didn't",
    "doesnt": "doesn't",
    "dont": "don't",
    "hadnt": "hadn't",
    "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've",
    "hasnt": "hasn't",
    "havent": "haven't",
    "hed": "he'd",
    "hed've": "he'd've",
    "he'dve": "he'd've",
    "hes": "he's",
    "howd": "how'd",
    "howll": "how'll",
    "hows": "how's",
    "Id've": "I'd've",
    "I'dve": "I'd've",
    "Im": "I'm",
    "Ive": "I've",
    "isnt": "isn't",
    "itd": "it'd",
    "itd've": "it'd've",
    "it'dve": "it'd've",
    "itll": "it'll",
    "let's": "let's",
    "maam": "ma'am",
    "mightnt": "mightn't",
    "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've",
    "mightve": "might've",
    "mustnt": "mustn't",
    "mustve": "must've",
    "neednt": "needn't",
    "notve": "not've",
    "oclock": "o'clock",
    "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at",
    "shant": "shan't",
    "shed've": "she'd've",
    "she'dve": "she'd've",
    "she's": "she's",
    "shouldve": "should've",
    "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've",
    "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll",
    "somebodys": "somebody's",
    "someoned": "someone'd",
    "someoned've": "someone'd've",
    "someone'dve": "someone'd've",
    "someonell": "someone'll",
    "someones": "someone's",
    "somethingd": "something'd",
    "somethingd've": "something'd've",
    "something'dve": "something'd've",
    "somethingll": "something'll",
    "thats": "that's",
    "thered": "there'd",
    "thered've": "there'd've",
    "there'dve": "there'd've",
    "therere": "there're",
    "theres": "there's",
    "theyd": "they'd",
    "theyd've": "they'd've",
    "they'dve": "they'd've",
    "theyll": "they'll",
    "theyre": "they're",
    "theyve": "they've",
    "twas": "'twas",
    "wasnt": "wasn't",
    "wed've": "we'd've",
    "we'dve": "we'd've",
    "weve": "we've",
    "werent": "weren't",
    "whatll": "what'll",
    "whatre": "what're",
    "whats": "what's",
    "whatve": "what've",
    "whens": "when's",
    "whered": "where'd",
    "wheres": "where's",
    "whereve": "where've",
    "whod": "who'd",
    "whod've": "who'd've",
    "who'dve": "who'd've",
    "wholl": "who'll",
    "whos": "who's",
    "whove": "who've",
    "whyll": "why'll",
    "whyre": "why're",
    "whys": "why's",
    "wont": "won't",
    "wouldve": "would've",
    "wouldnt": "wouldn't",
    "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've",
    "yall": "y'all",
    "yall'll": "y'all'll",
    "y'allll": "y'all'll",
    "yall'd've": "y'all'd've",
    "y'alld've": "y'all'd've",
    "y'all'dve": "y'all'd've",
    "youd": "you'd",
    "youd've": "you'd've",
    "you'dve": "you'd've",
    "youll": "you'll",
    "youre": "you're",
    "youve": "you've",
}
BOI, EOI, IMAGE_TOKEN = "<img>", "</img>", "<img_%05d>"
_LEFT, _RIGHT = IMAGE_TOKEN.split("%05d")
IMAGE_IDS, IMAGE_CODES, IMAGE_ID_SHIFT = 32, 8192, 32000
# ----------------------------------------------------------------------------------------------------------------------


def first_words(text: Column, n: int) -> Column:
    """The first n pieces between single spaces."""
    return F.array_join(F.slice(F.split(text, " ", -1), 1, n), " ")


def caption_clean(text: Column, max_words: int = 50, prompt: str = "") -> Column:
    """Lower case, marks to spaces, white space runs to one, trimmed, the first words, behind a prompt."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), CLEAN_MARKS, " "), r"\s{2,}", " ")
    return F.concat(F.lit(prompt), first_words(F.btrim(F.rtrim(t, F.lit("\n")), F.lit(" ")), max_words))


def question_clean(text: Column, max_words: int = 50) -> Column:
    """Lower case, marks removed, trailing spaces gone, the first words; runs of spaces stay."""
    return first_words(F.rtrim(F.regexp_replace(F.lower(text), CLEAN_MARKS, ""), F.lit(" ")), max_words)


def is_blank(text: Column) -> Column:
    """Nothing but spaces and a few marks; tabs and newlines do not count as blank. Trimming the left alone stops at the first other
    character, while trimming the right goes through the whole text."""
    return F.ltrim(text, F.lit(BLANK_CHARS)) == ""


def tidy_answer(text: Column) -> Column:
    return F.trim(F.translate(text, "\n\t", "  "))


def normalize_punctuation(text: Column) -> Column:
    """Each mark is deleted where the text as given has it next to a space, or has a digit-comma-digit; elsewhere it
    becomes a space. Then periods go that no digit follows (of at most 32 such a text has, all)."""
    out, comma = text, text.rlike(r"[0-9],[0-9]")
    for p in PUNCTUATION:
        beside = comma | F.contains(text, F.lit(p + " ")) | F.contains(text, F.lit(" " + p))
        out = F.replace(out, F.lit(p), F.when(beside, F.lit("")).otherwise(F.lit(" ")))
    return F.regexp_replace(out, r"\.(?![0-9])", "")


def normalize_words(text: Column) -> Column:
    """Lower-cased words, number words as digits, articles dropped, apostrophes put back."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda w: w != "")
    numbers, forms = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (NUMBER_WORDS, CONTRACTIONS))
    words = F.transform(words, lambda w: F.coalesce(numbers[w], w))
    words = F.filter(words, lambda w: ~w.isin(ARTICLES))
    return F.array_join(F.transform(words, lambda w: F.coalesce(forms[w], w)), " ")


def normalize_answer(text: Column) -> Column:
    return normalize_words(normalize_punctuation(tidy_answer(text)))


def ensure_period(text: Column) -> Column:
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def strip_periods(text: Column) -> Column:
    return F.rtrim(text, F.lit("."))


def after_marker(text: Column, marker: str) -> Column:
    """The parts behind each occurrence of a marker."""
    return bind(F.split(text, r"\Q" + marker + r"\E", -1), lambda parts: F.slice(parts, 2, F.size(parts)))


def image_tokens(ids: Column) -> Column:
    """<img>, a token for each id, </img>. Ids of up to five digits, which all are where none is null, negative or longer, are
    written as one text of numbers of six digits, whose marks are replaced: no function runs for each id but an addition."""
    one = lambda i: F.format_string(IMAGE_TOKEN, i)

    def tokens(ids: Column) -> Column:
        plain = (F.array_min(ids) >= 0) & (F.array_max(ids) < 100_000) & ~F.exists(ids, lambda i: i.isNull())
        text = F.transform(ids, lambda i: i + 100_000).cast("string")
        for mark, tag in ((", 1", _RIGHT + _LEFT), ("[1", BOI + _LEFT), ("]", _RIGHT + EOI)):
            text = F.replace(text, F.lit(mark), F.lit(tag))
        return F.when(plain, text).otherwise(F.concat(F.lit(BOI), F.array_join(F.transform(ids, one), ""), F.lit(EOI)))

    return bind(ids, tokens)


def parse_image_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"<img_([0-9]{5})>"), 1), lambda x: x.cast("int"))


def base_name_id(path: Column) -> Column:
    """The id in an image file's name: last path part, characters of ".jpg" stripped at both ends, behind the last "_"."""
    name = F.element_at(F.split(path, "/", -1), -1)
    return F.element_at(F.split(F.btrim(name, F.lit(".jpg")), "_", -1), -1)


def image_pair_words(text: Column) -> Column:
    """"image a" and "image b" as "the first image" and "the second image", wherever the letters stand."""
    for letter, word in (("a", "first"), ("A", "first"), ("b", "second"), ("B", "second")):
        text = F.replace(text, F.lit(f"image {letter}"), F.lit(f"the {word} image"))
    return text
