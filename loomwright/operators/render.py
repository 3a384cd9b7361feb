"""Sample renderers: each is an ordered array of segments, and one kernel turns segments into ids, masks and labels.

A segment is struct(text, supervised). Renderers take Columns and give a segments Column, so that a whole table is
rendered by one projection without a shuffle; random choices come from a hash of the row's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions.rng import pick, u01
from loomwright.functions.text import BOI, EOI, after_marker, ensure_period, image_pair_words, image_tokens, is_blank, strip_periods
from loomwright.functions.vectors import bind

# --- fixed values -----------------------------------------------------------------------------------------------------
USER, ASSISTANT = "USER:", "ASSISTANT:"
GENERATE_PROMPTS = [
    "Please show me a picture of",
    "Please design an image of",
    "Please produce a photo of",
    "Please generate an image of",
    "Please draw a painting of",
    "I'd like to see a drawing of",
    "I'd love to see an illustration of",
    "I'd like to view an image of",
    "I want to see a picture of",
    "I would like to see a photo of",
    "Show me a photo of",
    "Generate a picture of",
    "Show me a photograph of",
    "Generate an image of",
    "Can you make an image of",
    "Can you draw a painting of",
    "Can you produce a picture of",
    "Can you generate a photo of",
    "Can you depict a picture of",
    "Can you show me an illustration of",
]
GENERATE_RESPONSES = [
    "Here is a picture.",
    "I have designed an image.",
    "Here is a photo.",
    "I have generated an image.",
    "Here's a painting.",
    "Here's a drawing.",
    "Enjoy this illustration.",
    "Take a look at this image.",
    "Here is a picture.",
    "I have created a photo.",
    "Enjoy this photo.",
    "I have generated a picture.",
    "Here is a photograph.",
    "Here's an image.",
    "Certainly, here's an image.",
    "Absolutely, here is a painting.",
    "Sure, here is a picture.",
    "Of course, here is a photo.",
    "Certainly, please enjoy this picture.",
    "Sure, please enjoy this illustration.",
]
FIRST_QUESTION_PROMPT = 14
EDIT_RESPONSES = [
    "Here is a picture.",
    "I have created an image.",
    "Enjoy this picture.",
    "I have generated an image.",
    "Here's a picture.",
    "Here's an image.",
]
EDIT_PREFIX = "Edit this image with the instruction: "
STORY_PROMPTS = [
    "Can you use images and texts to tell me what will happen next?",
    "Would you utilize pictures and texts to show me the following story?",
    "Can you show me with images and texts what will occur then?",
    "Can you tell me the following event using images and written descriptions?",
    "Can you use images and texts to express to me the forthcoming happenings?",
    "Please use images and text to inform me what will happen next.",
    "Through pictures and text, let me know what will happen later.",
    "Show me with images and texts what will occur then.",
    "Please utilize pictures and descriptions to tell me what will happen subsequently.",
    "Please generate the following story using both images and texts.",
]
STORY_RESPONSES = [
    "Sure, let me tell you what will happen next using images and texts.",
    "I would be happy to utilize pictures and texts to show you the following story.",
    "Certainly, I can show you with images and texts what will occur then.",
    "Of course! Let me tell you the following event using images and written descriptions.",
    "Sure, here are images and texts to let you know the forthcoming happenings.",
    "Here are images and text to inform you what will happen next.",
    "Please see the pictutres and text to know what will happen later.",
    "Here are images and texts for you to know what will occur then.",
    "Let me show you what will happen subsequently with pictures and descriptions.",
    "I have generated the following story using both images and texts.",
]
STORY_STEP, STORY_STEP_RESPONSE = " Please generate an image.", "Here is an image."
FIRST_IMAGE, SECOND_IMAGE = "This is the first image.", "This is the second image."
NO_QUESTIONS, QUESTION, ANSWER = "Image Descriptions", "Question: ", "Answer: "
NOISY_SUFFIX = "\nQA_GT_caption_based_noisy"
END_OF_CHUNK = "<|endofchunk|>"
REASON_HEAD = "Please reason the answer of the questions according to the given contexts.\n"
REASON_EXAMPLES = "\nAnswer:yes\nQuestion:Is this a toilet?\nAnswer:no\n"
# ----------------------------------------------------------------------------------------------------------------------

Tokenize = Callable[[Column], Column]
#: What rendering adds; columns with such names are replaced.
OUTPUTS = ("text", "input_ids", "attention_mask", "labels", "truncated", "filter_flag")
SEGMENTS = "array<struct<text:string,supervised:boolean>>"


def segment(text: Column | str, supervised: bool = False) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(supervised).alias("supervised"))


def _one_of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _bounded(tokenize: Tokenize, length: int) -> Tokenize:
    """The tokenizer for a result that is cut to ``length``: a part needs no more ids than that, and is cut either way."""
    return (lambda c: A.word_ids(c, length)) if tokenize is A.word_ids else tokenize


def tokens_and_labels(parts: Column) -> tuple[Column, Column]:
    """Ids of tokenized segments (structs of ids and supervised) between begin and end, and labels: -100 but for supervised
    segments and the end."""
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    labels = F.flatten(F.transform(parts, lambda p: F.when(p["supervised"], p["ids"]).otherwise(A.ignored(p["ids"]))))
    bos, eos = F.array(F.lit(A.BOS_ID)), F.array(F.lit(A.EOS_ID))
    return F.concat(bos, ids, eos), F.concat(F.array(F.lit(A.IGNORE)), labels, eos)


def finish(df: DataFrame, segments: Column, length: int, tokenize: Tokenize = A.word_ids) -> DataFrame:
    """``df`` with text, input_ids, attention_mask, labels (all ``length`` long) and truncated; rows whose segments are
    or one of whose texts are null get null ids, and filter_flag false. Cutting to the length may remove the end id."""
    tokenize = _bounded(tokenize, length)
    parts = F.transform("_s", lambda s: F.struct(tokenize(s["text"]).alias("ids"), s["supervised"].alias("supervised")))
    ids, labels = tokens_and_labels(F.col("_p"))
    df = df.withColumn("_s", segments).withColumn("_p", parts).withColumn("_i", ids).withColumn("_l", labels)
    return df.select(
        *[c for c in df.columns if c not in ("_s", "_p", "_i", "_l", *OUTPUTS)],
        text_of(F.col("_s")).alias("text"),
        A.pad_truncate(F.col("_i"), length).alias("input_ids"),
        A.attention(F.size("_i"), length).alias("attention_mask"),
        A.pad_truncate(F.col("_l"), length, A.IGNORE).alias("labels"),
        (F.size("_i") > length).alias("truncated"),
        F.coalesce(F.forall("_s", lambda s: s["text"].isNotNull()), F.lit(False)).alias("filter_flag"),
    )


def finish_text(df: DataFrame, text: Column, length: int, tokenize: Tokenize = A.word_ids, masked: Column | None = None, keep: Column | None = None) -> DataFrame:
    """As finish(), for one text between begin and end in which every id is supervised but pads (by id, so unknown words
    that share the pad's id are ignored too) and the first ``masked`` ids."""
    ids = _bounded(tokenize, length)(F.col("_t"))
    df = df.withColumn("_t", text).withColumn("_i", F.concat(F.array(F.lit(A.BOS_ID)), ids, F.array(F.lit(A.EOS_ID))))
    ids = A.pad_truncate(F.col("_i"), length)
    labels = A.mask_id(ids)
    flag = F.col("_t").isNotNull() & (F.lit(True) if keep is None else keep)
    if masked is not None:
        labels = A.mask_prefix(labels, masked)
        flag = flag & (masked <= length)
    return df.select(
        *[c for c in df.columns if c not in ("_t", "_i", *OUTPUTS)], F.col("_t").alias("text"), ids.alias("input_ids"), A.attention(F.size("_i"), length).alias("attention_mask"), labels.alias("labels"), (F.size("_i") > length).alias("truncated"), flag.alias("filter_flag")
    )


def image_first(key: Column, ratio: float, salt: str = "direction") -> Column:
    return u01(key, salt) < ratio


def caption_pair_text(ids: Column, text: Column, key: Column, ratio: float = 0.5, prompts: list[str] | None = None) -> Column:
    """Image then caption where the key's number is under the ratio, else caption then image; the caption in one of the prompts."""
    caption = text
    if prompts:
        chosen = _one_of(prompts, pick(key, "prompt", len(prompts)))
        caption = F.replace(chosen, F.lit("{}"), text)
    image = image_tokens(ids)
    return F.when(image_first(key, ratio), F.concat(image, caption)).otherwise(F.concat(caption, image))


def caption_pair(df: DataFrame, ids: Column, text: Column, key: Column, length: int = 128, ratio: float = 0.5, mask_left: bool = False, tokenize: Tokenize = A.word_ids, prompts: list[str] | None = None) -> DataFrame:
    """Caption and image in either order; ``mask_left`` ignores all up to the end of the first part: through </img> where
    the image comes first, through <img> where it comes last. Blank captions and marks that were cut off are flagged."""
    whole = caption_pair_text(ids, text, key, ratio, prompts)
    masked = None
    if mask_left:
        before = F.when(image_first(key, ratio), F.concat(F.substring_index(whole, EOI, 1), F.lit(EOI))).otherwise(F.concat(F.substring_index(whole, BOI, 1), F.lit(BOI)))
        masked = F.size(tokenize(before)) + 1
    return finish_text(df, whole, length, tokenize, masked, ~is_blank(text))


def edit_pair(df: DataFrame, source: Column, target: Column, instruction: Column, length: int = 128, tokenize: Tokenize = A.word_ids) -> DataFrame:
    """Source image, instruction, target image; labels begin behind the begin id, 34 image ids and the instruction's ids."""
    order = F.replace(instruction, F.lit(EDIT_PREFIX), F.lit(""))
    return finish_text(df, F.concat(image_tokens(source), order, image_tokens(target)), length, tokenize, F.lit(1 + 34) + F.size(tokenize(order)))


def text_pretrain(df: DataFrame, text: Column, length: int = 512, tokenize: Tokenize = A.word_ids) -> DataFrame:
    return finish_text(df, text, length, tokenize, keep=~is_blank(text))


def interleaved_ok(items: Column) -> Column:
    """Every item has exactly one of image_ids and text."""
    return F.forall(items, lambda x: x["image_ids"].isNull() != x["text"].isNull())


def swap_images(items: Column) -> Column:
    """Each image changes places with the item behind it, pair by pair from the left; a last image stays."""
    def step(acc, x):
        free = F.size(acc["held"]) == 0
        return F.when(free & x["image_ids"].isNotNull(), F.struct(acc["out"].alias("out"), F.array(x).alias("held"))).otherwise(
            F.struct(F.concat(acc["out"], F.array(x), acc["held"]).alias("out"), F.slice(acc["held"], 1, 0).alias("held"))
        )

    start = F.struct(F.slice(items, 1, 0).alias("out"), F.slice(items, 1, 0).alias("held"))
    return F.aggregate(items, start, step, lambda acc: F.concat(acc["out"], acc["held"]))


def cap_images(items: Column, most: int) -> Column:
    """Items up to the cap: an image over it ends the document before itself, a text at it ends it behind itself."""
    n = F.size(items)
    images = lambda upto: F.size(F.filter(F.slice(items, 1, upto), lambda y: y["image_ids"].isNotNull()))
    stop = F.transform(items, lambda x, i: F.when(images(i) >= most, F.when(x["image_ids"].isNotNull(), i).otherwise(i + 1)))
    return F.slice(items, 1, F.coalesce(F.array_min(stop), n))


def interleaved_text(items: Column, key: Column, ratio: float = 0.5, most: int | None = None) -> Column:
    swapped = F.when(image_first(key, ratio), swap_images(items)).otherwise(items)
    kept = swapped if most is None else cap_images(swapped, most)
    parts = F.transform(kept, lambda x: F.coalesce(image_tokens(x["image_ids"]), x["text"]))
    return F.when(interleaved_ok(items), F.array_join(parts, ""))


def conversation(contents: Column, system: str = "", roles: tuple[str, str] = ("USER", "ASSISTANT"), sep: str = "\n", sft: bool = False, image: Column | None = None, image_leads: Column | None = None) -> Column:
    """Turns by parity: even ones wrapped in roles and ignored, odd ones supervised. Fine-tuning (``sft``) strips turns
    given an image, ends answers with a period then, and has no space behind the answerer's role."""
    ask, reply = (USER + " ", ASSISTANT) if sft else (roles[0] + ": ", roles[1] + ": ")

    def turn(x, i):
        x = F.trim(x) if sft and image is not None else x
        first = x
        if image is not None:
            first = F.concat(image, x) if image_leads is None else F.when(image_leads, F.concat(image, x)).otherwise(F.concat(x, image))
        asked = F.concat(F.when(i == 0, "").otherwise(sep), F.lit(ask), F.when(i == 0, first).otherwise(x), F.lit(sep), F.lit(reply))
        answered = ensure_period(x) if sft and image is not None else x
        return F.when(i % 2 == 0, F.struct(asked.alias("text"), F.lit(False).alias("supervised"))).otherwise(F.struct(answered.alias("text"), F.lit(True).alias("supervised")))

    turns = F.transform(contents, turn)
    if not system:
        return turns
    return F.concat(F.array(segment(system if system.endswith("\n") else system + "\n")), turns)


def instruction_pair(instruction: Column, inputs: Column, outputs: Column, image: Column, sft: bool = True, image_leads: Column | None = None) -> Column:
    """Inputs (the instruction where they are blank) with the image, and the outputs supervised."""
    asked = F.when(F.trim(inputs) == "", instruction).otherwise(inputs)
    asked = F.concat(image, asked) if image_leads is None else F.when(image_leads, F.concat(image, asked)).otherwise(F.concat(asked, image))
    head, tail = (USER + " ", "\n" + ASSISTANT) if sft else ("USER: ", "\nASSISTANT: ")
    return F.array(segment(F.concat(F.lit(head), asked, F.lit(tail))), segment(outputs, True))


def _asked(*parts: Column | str, again: bool = False) -> Column:
    return segment(F.concat(F.lit(("\n" if again else "") + USER + " "), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n" + ASSISTANT)))


def retrieval_augmented(target: Column, context: Column, key: Column, ratio: float = 0.5, most: int | None = None, mask_left: bool = True) -> Column:
    """The target and then the context in the order of a hash, at most ``most`` in all; each is a left and a right part."""
    order = F.transform(context, lambda x: F.struct(F.md5(F.concat(key.cast("string"), F.lit(":"), x["text"])).alias("h"), x.alias("x")))
    rest = F.transform(F.array_sort(order), lambda x: x["x"])
    every = F.concat(F.array(target), rest if most is None else F.slice(rest, 1, most - 1))
    image_leads = image_first(key, ratio)
    pair = lambda x: F.when(image_leads, F.array(F.struct(image_tokens(x["image_ids"]).alias("text"), F.lit(not mask_left).alias("supervised")), F.struct(x["text"].alias("text"), F.lit(True).alias("supervised")))).otherwise(
        F.array(F.struct(x["text"].alias("text"), F.lit(not mask_left).alias("supervised")), F.struct(image_tokens(x["image_ids"]).alias("text"), F.lit(True).alias("supervised")))
    )
    return F.flatten(F.transform(every, pair))


def few_shot_caption(ids: Column, context: Column, shots: int = 2, prompt: str = "") -> Column:
    """Context images with their texts, the image, and a prompt; neither end nor padding."""
    shown = F.array_join(F.transform(F.slice(context, 1, shots), lambda x: F.concat(image_tokens(x["image_ids"]), x["text"])), "")
    return F.concat(shown, image_tokens(ids), F.lit(prompt))


def frames(ids: Column, most: int | None = None) -> Column:
    parts = F.transform(A.slices(ids), image_tokens)
    return F.array_join(parts if most is None else F.slice(parts, 1, most), "")


def video_caption(ids: Column, caption: Column, most: int = 4) -> Column:
    return F.array(segment(frames(ids, most)), segment(caption, True))


def edit_turn(source: Column, target: Column, instruction: Column, key: Column, instruction_gpt: Column | None = None, response: Column | None = None) -> Column:
    """One turn; a given rewording and response go first, else one of the first six responses."""
    said = _one_of(EDIT_RESPONSES, pick(key, "edit", len(EDIT_RESPONSES)))
    if instruction_gpt is not None:
        said, instruction = F.when(instruction_gpt.isNotNull(), response).otherwise(said), F.coalesce(instruction_gpt, instruction)
    return F.array(_asked(image_tokens(source), instruction), segment(F.concat(said, image_tokens(target)), True))


def edit_turns(ids: Column, instructions: list[Column], key: Column) -> Column:
    """As many turns as instructions over the image's states, one response for all."""
    said = _one_of(EDIT_RESPONSES, pick(key, "edit", len(EDIT_RESPONSES)))

    def turns(states: Column) -> Column:
        out = []
        for i, order in enumerate(instructions):
            out += [_asked(image_tokens(states[0]), order) if i == 0 else _asked(order, again=True), segment(F.concat(said, image_tokens(states[i + 1])), True)]
        return F.array(*out)

    return bind(A.slices(ids), turns)


def marked_pairs(question: Column, answer: Column) -> Column:
    """(q, a) of the k-th marked question and answer, stripped, as many as there are of both."""

    def pairs(found: Column) -> Column:
        n = F.least(F.size(found["q"]), F.size(found["a"]))
        return F.zip_with(F.slice(found["q"], 1, n), F.slice(found["a"], 1, n), lambda q, a: F.struct(F.trim(q).alias("q"), F.trim(a).alias("a")))

    return bind(F.struct(after_marker(question, QUESTION).alias("q"), after_marker(answer, ANSWER).alias("a")), pairs)


def marked_conversation(question: Column, answer: Column, image: Column, video: bool = False) -> Column:
    """Turns of marked questions and answers; answers about an image end with a period. A question with image
    descriptions leaves the body empty but the sample in."""
    made = F.transform(
        marked_pairs(question, answer),
        lambda p, i: F.array(
            F.struct(F.concat(F.when(i == 0, F.concat(F.lit(USER + " "), image)).otherwise(F.lit("\n" + USER + " ")), p["q"], F.lit("\n" + ASSISTANT)).alias("text"), F.lit(False).alias("supervised")),
            F.struct((p["a"] if video else ensure_period(p["a"])).alias("text"), F.lit(True).alias("supervised")),
        ),
    )
    return F.when(F.contains(question, F.lit(NO_QUESTIONS)), F.array().cast(SEGMENTS)).otherwise(F.flatten(made))


def difference(ids: Column, question: Column, answer: Column, key: Column) -> Column:
    q, a = image_pair_words(F.trim(question)), ensure_period(image_pair_words(F.trim(answer)))

    def turn(two: Column) -> Column:
        one, other = image_tokens(two[0]), image_tokens(two[1])
        behind = F.concat(one, F.lit(FIRST_IMAGE), other, F.lit(SECOND_IMAGE + " "), q)
        before = F.concat(F.lit(FIRST_IMAGE), one, F.lit(SECOND_IMAGE), other, q)
        return F.array(_asked(F.when(u01(key, "template") < 0.5, behind).otherwise(before)), segment(a, True))

    return bind(A.slices(ids), turn)


def story(ids: Column, captions: Column, key: Column, steps: bool) -> Column:
    """Five captions and images: four turns with one image each, or one turn that tells the rest."""
    return bind(F.struct(A.slices(ids).alias("im"), F.transform(captions, lambda x: F.trim(x)).alias("c")), lambda s: _story(s["im"], s["c"], key, steps))


def _story(im: Column, c: Column, key: Column, steps: bool) -> Column:
    image = lambda i: image_tokens(im[i])
    if steps:
        out = [_asked(c[0], image(0), c[1], STORY_STEP), segment(F.concat(F.lit(STORY_STEP_RESPONSE), image(1)), True)]
        for i in (2, 3, 4):
            out += [_asked(c[i], STORY_STEP, again=True), segment(F.concat(F.lit(STORY_STEP_RESPONSE), image(i)), True)]
        return F.array(*out)
    at = pick(key, "story", len(STORY_PROMPTS))
    told = F.concat(_one_of(STORY_RESPONSES, at), *[x for i in (1, 2, 3, 4) for x in (F.lit("\n"), c[i], image(i))])
    return F.array(_asked(c[0], image(0), _one_of(STORY_PROMPTS, at)), segment(told, True))


def question_or_generation(ids: Column, question: Column, answer: Column, key: Column, ratio: float) -> Column:
    """A ratio of 0: always a question about the image; under 0: always an image for the answer; else by the key."""
    image = image_tokens(ids)
    asked = F.array(_asked(image, F.trim(question)), segment(ensure_period(F.trim(answer)), True))
    at = pick(key, "generate", len(GENERATE_PROMPTS))
    mark = F.when(at >= FIRST_QUESTION_PROMPT, "?").otherwise(".")
    made = F.array(_asked(_one_of(GENERATE_PROMPTS, at), " ", strip_periods(F.trim(answer)), mark), segment(F.concat(_one_of(GENERATE_RESPONSES, at), image), True))
    return asked if ratio == 0 else F.when(image_first(key, ratio), asked).otherwise(made)


def instruction_response(instruction: Column, response: Column) -> Column:
    return F.array(_asked(instruction), segment(response, True))


def video_question(ids: Column, question: Column, answer: Column) -> Column:
    return F.array(_asked(frames(ids), F.trim(question)), segment(ensure_period(F.replace(F.trim(answer), F.lit(NOISY_SUFFIX), F.lit(""))), True))


def context_captions(answers: Column, captions: Column, places: Column, most: int = 30) -> Column:
    """Captions for a question, one after the other: the answers are gone through from the last, ``most`` steps around, and
    each gives its first caption (``places``: for each answer its captions' places; null: the first caption) not taken yet."""
    n = F.size(answers)

    def step(acc, k):
        own = F.coalesce(places[F.pmod(n - 1 - k, n).cast("int")], F.array(F.lit(0)))
        c = F.get(F.filter(own, lambda p: ~F.exists(acc, lambda a: a == p)), 0)
        return F.when(c.isNull(), acc).otherwise(F.concat(acc, F.array(c)))

    taken = F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.expr("cast(array() as array<int>)"), step)
    return F.array_join(F.transform(taken, lambda p: captions[p]), "")


def reason_prompt(question: Column, answers: Column, questions: Column, captions: Column, places: Column, most: int = 30) -> Column:
    """The whole prompt for answering a question from captions: contexts, one generated question answered yes and a fixed one
    answered no, and the question itself."""
    contexts = context_captions(answers, captions, places, most)
    examples = F.concat(F.lit("Question:"), F.element_at(questions, -1), F.lit(REASON_EXAMPLES))
    return F.concat(F.lit(REASON_HEAD + "Contexts:"), contexts, F.lit("\n"), examples, F.lit("Question:"), question, F.lit("\nAnswer:"))


def chunked_caption(text: Column, eos: str = "</s>") -> Column:
    return F.concat(F.lit("<image>"), text, F.lit(END_OF_CHUNK + eos))


_CHUNK_TOKENS = r"<image>|<\|endofchunk\|>|[^\s<]+|<"


def chunked_document(texts: Column, matched: Column, eos: str = "</s>") -> Column:
    """Sentences with <|endofchunk|><image> before one for each image that it matches, joined by spaces; the first chunk end goes, as
    do spaces before chunk ends and on both sides of images; a chunk end and ``eos`` close the text. ``matched`` has places of
    sentences, from 0, and those that there are none of don't count."""
    mark = f"{END_OF_CHUNK}<image>"
    joined = lambda own: F.array_join(F.transform(texts, lambda t, i: F.concat(F.repeat(F.lit(mark), F.size(F.filter(own, lambda m: m == i))), t)), " ")
    # matches are worked out once, not once for each sentence, and so is the joined text
    return bind(bind(matched, joined), lambda body: _without_first(body, eos))


def _without_first(body: Column, eos: str) -> Column:
    first = F.instr(body, END_OF_CHUNK)
    cut = F.when(first > 0, F.concat(F.substr(body, F.lit(1), first - 1), F.substr(body, first + len(END_OF_CHUNK)))).otherwise(body)
    for old, new in ((f" {END_OF_CHUNK}", END_OF_CHUNK), ("<image> ", "<image>"), (" <image>", "<image>")):
        cut = F.replace(cut, F.lit(old), F.lit(new))
    return F.concat(cut, F.lit(END_OF_CHUNK + eos))


def chunk_images(text: Column, max_length: int) -> Column:
    """How many images are among the first ``max_length`` marks, words and signs of a chunked text."""
    return F.size(F.filter(F.slice(F.regexp_extract_all(text, F.lit(_CHUNK_TOKENS), F.lit(0)), 1, max_length), lambda t: t == "<image>"))


# --- what evaluation asks (fixed values) ------------------------------------------------------------------------------
DESCRIBE = "Please provide an accurate and concise description of the given {}."
ONE_WORD = " Please provide an accurate answer consisting of only one word or phrase."
DIALOG_SYSTEM = "Based on the image caption and dialog history, answer the following question.\n"
BRIEF_CAPTION = "Generate a caption for this image briefly."


def asked(style: str, question: Column) -> Column:
    """What an evaluation sample asks: a description of its image or video, a question as it is, one to be answered in a word
    (of a video with a question mark behind it), or one behind the rule for dialogues."""
    return {
        "describe_image": lambda: F.lit(DESCRIBE.format("image")),
        "describe_video": lambda: F.lit(DESCRIBE.format("video")),
        "caption": lambda: F.lit(BRIEF_CAPTION),
        "plain": lambda: question,
        "word": lambda: F.concat(question, F.lit(ONE_WORD)),
        "word_video": lambda: F.concat(F.when(F.endswith(question, F.lit("?")), question).otherwise(F.concat(question, F.lit("?"))), F.lit(ONE_WORD)),
        "dialog": lambda: F.concat(F.lit(DIALOG_SYSTEM), question),
    }[style]()


def asked_turns(turns: Column) -> tuple[Column, Column]:
    """All questions, and all answers, of an array of (q, a), each behind its name, joined by spaces."""
    return tuple(F.trim(F.array_join(F.transform(turns, lambda t: F.concat(F.lit(mark), t[k], F.lit(" "))), "")) for mark, k in ((QUESTION, "q"), (ANSWER, "a")))
