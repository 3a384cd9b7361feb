"""Declared pipelines: source, renderer, filter, shuffle, batch, each a spec that build() turns into one DataFrame.

A spec names its defaults; build() takes overrides. Sources are tables of decoded samples (see loomwright.sources for
shards and files), so that a pipeline is one projection, one filter and, where it shuffles, one sort key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions import text as X
from loomwright.functions.vectors import bind
from loomwright.operators import curate as C
from loomwright.operators import mixing as M
from loomwright.operators import render as R
from loomwright.plans.registry import REGISTRY


@dataclass(frozen=True)
class Pipeline:
    loader: str  # tar, jsonl, json_list, coco or table
    render: str
    keep: str
    cycle: int | None = None
    shards: str = "file"  # what is dealt to ranks: files or records
    shuffle: bool = True
    collate: bool = True
    options: dict = field(default_factory=dict)


RENDERERS: dict[str, Callable[..., DataFrame]] = {}


def renderer(name: str):
    def add(fn):
        if name in RENDERERS:
            raise KeyError(name)
        RENDERERS[name] = fn
        return fn

    return add


def _segments(fn):
    """A renderer from one that gives segments for (columns as F.col, options)."""

    def run(df: DataFrame, key: str, max_length: int = 512, **o) -> DataFrame:
        return R.finish(df, fn(F.col(key), **o), max_length)

    return run


@renderer("caption")
def _caption(df, key, max_length=128, reverse_ratio=0.5, mask_left_label=False, caption_prompt=None, use_caption_in_metadata=False, caption_key_in_metadata="top_caption"):
    text = F.get_json_object("metadata", f"$.{caption_key_in_metadata}") if use_caption_in_metadata else F.col("text")
    prompts = [caption_prompt] if isinstance(caption_prompt, str) else caption_prompt
    return R.caption_pair(df.withColumn("caption", text), F.col("image_ids"), F.col("caption"), F.col(key), max_length, reverse_ratio, mask_left_label, prompts=prompts)


@renderer("edit")
def _edit(df, key, max_length=128):
    return R.edit_pair(df, F.col("source_image_ids"), F.col("target_image_ids"), F.col("instruction"), max_length)


@renderer("interleaved")
def _interleaved(df, key, max_length=512, reverse_ratio=0.5, max_images=None):
    items = F.zip_with("image_ids", "texts", lambda i, t: F.struct(i.alias("image_ids"), t.alias("text")))
    return R.finish_text(df, R.interleaved_text(items, F.col(key), reverse_ratio, max_images), max_length)


@renderer("retrieval")
def _retrieval(df, key, max_length=512, reverse_ratio=0.5, max_images=None, mask_left_label=True):
    own = F.struct(F.col("image_ids"), F.col("text"))
    context = F.transform("context", lambda c: F.struct(c["image_ids"].alias("image_ids"), c["text"].alias("text")))
    s = R.retrieval_augmented(own, context, F.col(key), reverse_ratio, max_images, mask_left_label)
    return R.finish(df, s, max_length)


@renderer("few_shot")
def _few_shot(df, key, caption_prompt="", num_context=2):
    return df.withColumn("prompt", R.few_shot_caption(F.col("image_ids"), F.col("context"), num_context, caption_prompt or "")).withColumn("input_ids", R.A.word_ids(F.col("prompt"))).withColumn("filter_flag", F.col("prompt").isNotNull())


@renderer("text")
def _text(df, key, max_length=512):
    return R.text_pretrain(df.withColumnRenamed("text", "raw"), F.col("raw"), max_length)


def _conversation(sft):
    def run(key, system_message="", roles=("USER", "ASSISTANT"), sep="\n"):
        return R.conversation(F.col("data"), system_message, roles, sep, sft)

    return _segments(run)


def _visual(sft):
    def run(key, system_message="", roles=("USER", "ASSISTANT"), sep="\n"):
        image = F.array_join(F.transform("image_ids", X.image_tokens), "")
        leads = None if sft else R.u01(key, "image_side") < 0.5
        return R.conversation(F.col("data"), "" if sft else system_message, roles, sep, sft, image, leads)

    return _segments(run)


def _chunked(df: DataFrame, key: str, max_length: int, min_similarity: float, max_images: int) -> DataFrame:
    """Sentences (text_list) and images (structs of data, matched_sim, matched_text_index) as one chunked text, with the number of
    its images that the first ``max_length`` tokens hold; documents without one go, and half of those with one."""
    kept = F.slice(C.large_and_matched(F.col("images"), min_similarity), 1, max_images)
    made = bind(R.chunked_document(F.col("text_list"), F.transform(kept, lambda x: x["matched_text_index"])), lambda t: F.struct(t.alias("text"), R.chunk_images(t, max_length).alias("n")))
    out = df.withColumn("_made", made).where(bind(F.col("_made.n"), lambda n: C.keep_by_image_count(n, F.col(key))))
    return out.withColumns({"text": F.col("_made.text"), "num_images": F.col("_made.n")}).drop("_made")


RENDERERS |= {
    "conversation": _conversation(False),
    "conversation_sft": _conversation(True),
    "visual": _visual(False),
    "visual_sft": _visual(True),
    "video_caption": _segments(lambda key, num_frames=4, image_id_length=32, flat=True: R.video_caption(F.col("image_ids"), F.col("answer"), num_frames)),
    "edit_sft": _segments(lambda key, **_: R.edit_turn(F.col("source_image_ids"), F.col("target_image_ids"), F.col("instruction"), key)),
    "edit_multi": _segments(lambda key, **_: R.edit_turns(F.col("image_ids"), [F.col(f"instruction{i}") for i in range(3)], key)),
    "marked": _segments(lambda key, **_: R.marked_conversation(F.col("question"), F.col("answer"), X.image_tokens(F.col("image_ids")))),
    "marked_video": _segments(lambda key, **_: R.marked_conversation(F.col("question"), F.col("answer"), R.frames(F.col("image_ids")), video=True)),
    "qa": _segments(lambda key, reverse_ratio=0.0, **_: R.question_or_generation(F.col("image_ids"), F.col("question"), F.col("answer"), key, reverse_ratio)),
    "instruction": _segments(lambda key, **_: R.instruction_response(F.col("instruction"), F.col("response"))),
    "video_qa": _segments(lambda key, **_: R.video_question(F.col("image_ids"), F.col("question"), F.col("answer"))),
    "difference": _segments(lambda key, **_: R.difference(F.col("image_ids"), F.col("question"), F.col("answer"), key)),
    "story": _segments(lambda key, reverse_ratio=0.5, **_: R.story(F.col("image_ids"), F.array(*[F.col(f"caption{i}") for i in range(5)]), key, reverse_ratio == 0)),
    "pixels": lambda df, key, **_: df,
    "pixels_tokens": lambda df, key, max_length=128, **_: df.withColumn("input_ids", A.pad_truncate(A.word_ids(F.col("text"), max_length), max_length)).withColumn("attention_mask", A.attention(F.size(A.word_ids(F.col("text"))), max_length)),
    "chunked": lambda df, key, max_length=256, min_similarity=0.0, max_images=5, **_: _chunked(df, key, max_length, min_similarity, max_images),
    "ask": lambda df, key, style="plain", **_: df.withColumn("question", R.asked(style, F.col("question"))),
    "context_json": lambda df, key, **_: df.withColumn("context", R.F.to_json("context")),
}

FILTERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    # the flag says that there are ids, so that rows are filtered without working them out
    "rendered": lambda df, o: df.where(F.coalesce("filter_flag", F.lit(True))),
    "rendered_sft": lambda df, o: df.where(F.coalesce("filter_flag", F.lit(True))),
    "pixels_text": lambda df, o: df.where(C.all_present(F.col("pixel_values"), F.col("text"))),
    "pixels": lambda df, o: df.where(F.col("pixel_values").isNotNull()),
    "pixels_flag": lambda df, o: df.where(F.col("pixel_values").isNotNull() & C.aspect_flag(F.col("width"), F.col("height"))),
    "pixels_quality": lambda df, o: df.where(
        C.all_present(F.col("pixel_values"), F.col("text"))
        & C.image_quality_from_metadata(F.col("metadata"), w=F.col("width"), h=F.col("height"), min_similarity=o.get("similarity_thr", 0.2), min_side=o.get("min_resolution", 180), min_aspect=o.get("min_aspect_ratio", 0.666))
    ),
    "eval_any": lambda df, o: df.where(C.any_set_present([F.col("pixel_values"), F.col("text")], [F.col("pixel_values"), F.col("question")], [F.col("source_image"), F.col("instruction")])),
    "eval_asked": lambda df, o: df.where(C.all_present(F.col("pixel_values"), F.col("question"))),
    "all": lambda df, o: df,
}

_TAR = dict(loader="tar", keep="rendered", cycle=1)
_SFT = dict(loader="tar", keep="rendered_sft", cycle=1)
_PRE = dict(shuffle=False, collate=False)

PIPELINES: dict[str, Pipeline] = {
    # pre-training
    "pretrain_caption": Pipeline(render="caption", options={"max_length": 128, "reverse_ratio": 0.5}, **_TAR),
    "pretrain_edit": Pipeline(render="edit", options={"max_length": 128}, **_TAR),
    "pretrain_pixels": Pipeline("tar", "pixels", "pixels_text"),
    "pretrain_interleaved": Pipeline(render="interleaved", options={"max_length": 512, "reverse_ratio": 0.5}, **_TAR),
    "pretrain_retrieval": Pipeline(render="retrieval", options={"max_length": 512, "reverse_ratio": 0.5, "mask_left_label": True}, **_TAR),
    "eval_few_shot_caption": Pipeline("tar", "few_shot", "rendered", shards="record", shuffle=False, options={"num_context": 2}),
    "pretrain_conversation": Pipeline("jsonl", "conversation", "rendered", 1, shuffle=False, options={"max_length": 512}),
    "pretrain_visual": Pipeline(render="visual", options={"max_length": 512}, **_TAR),
    "pretrain_video_caption": Pipeline(render="video_caption", options={"max_length": 128, "num_frames": 4}, **_TAR),
    "pretrain_text": Pipeline("jsonl", "text", "rendered", 1, shuffle=False, options={"max_length": 512}),
    "pretrain_interleaved_pages": Pipeline(render="interleaved", options={"max_length": 512, "reverse_ratio": 0.5}, **_TAR),
    # fine-tuning
    "sft_edit": Pipeline(render="edit_sft", options={"max_length": 512}, **_SFT),
    "sft_edit_multi": Pipeline(render="edit_multi", options={"max_length": 512}, **_SFT),
    "sft_marked": Pipeline(render="marked", options={"max_length": 512}, **_SFT),
    "sft_marked_video": Pipeline(render="marked_video", options={"max_length": 512}, **_SFT),
    "sft_qa": Pipeline(render="qa", options={"max_length": 512, "reverse_ratio": 0.0}, **_SFT),
    "sft_instruction": Pipeline(render="instruction", options={"max_length": 512}, **_SFT),
    "sft_video_qa": Pipeline(render="video_qa", options={"max_length": 512}, **_SFT),
    "sft_video_generation": Pipeline(render="video_caption", options={"max_length": 512}, **_SFT),
    "sft_difference": Pipeline(render="difference", options={"max_length": 512}, **_SFT),
    "sft_story": Pipeline(render="story", options={"max_length": 512, "reverse_ratio": 0.5}, **_SFT),
    "sft_conversation": Pipeline("jsonl", "conversation_sft", "rendered_sft", 1, shuffle=False, options={"max_length": 512}),
    "sft_visual": Pipeline(render="visual_sft", options={"max_length": 512}, **_SFT),
    # preprocessing
    "preprocess_caption": Pipeline("tar", "pixels_tokens", "pixels_quality", options={"max_length": 128}, **_PRE),
    "preprocess_coco": Pipeline("coco", "pixels_tokens", "pixels_text", options={"max_length": 128}, shards="record", **_PRE),
    "preprocess_interleaved": Pipeline("tar", "pixels", "pixels", shuffle=False),
    "preprocess_retrieval": Pipeline("tar", "context_json", "all", **_PRE),
    "preprocess_instructions": Pipeline("table", "pixels", "all", shuffle=False),
    "preprocess_visual": Pipeline("jsonl", "pixels", "pixels_flag", shards="record", shuffle=False),
    # evaluation
    "eval_caption": Pipeline("tar", "pixels_tokens", "eval_any", options={"max_length": 128}, **_PRE),
    "eval_coco": Pipeline("json_list", "pixels_tokens", "eval_any", options={"max_length": 128}, shards="record", **_PRE),
    "eval_question": Pipeline("json_list", "ask", "eval_asked", options={"style": "describe_image"}, shards="record", **_PRE),
    "preprocess_chunked": Pipeline("json_list", "chunked", "all", options={"max_length": 256, "min_similarity": 0.24}, **_PRE),
    "eval_edit": Pipeline("json_list", "pixels", "eval_any", shards="record", **_PRE),
    "eval_video": Pipeline("json_list", "ask", "eval_asked", options={"style": "describe_video"}, shards="record", **_PRE),
}
for _name, _spec in PIPELINES.items():
    REGISTRY.add("pipeline", _name, _spec)


def build(name: str, source: DataFrame, key: str, batch_size: int | None = None, cycle_count: int | None = None, seed: int = 0, rank: int = 0, world: int = 1, **options) -> DataFrame:
    """The pipeline's samples, with epoch, shuffle_key (order by it) and, given a batch size, batch, where the spec has
    them. Endless cycles are bounded by ``cycle_count``. Options override the spec's."""
    spec: Pipeline = REGISTRY.get("pipeline", name)
    opts = {**spec.options, **options}
    filter_opts = {k: opts.pop(k) for k in ("similarity_thr", "min_resolution", "min_aspect_ratio") if k in opts}
    own = source if world == 1 else M.shard(source.withColumn("_n", F.abs(F.xxhash64(key))), "_n", world, rank).drop("_n")
    out = FILTERS[spec.keep](RENDERERS[spec.render](own, key, **opts), filter_opts)
    cycles = cycle_count or spec.cycle
    if cycles:
        out = M.cycle(out, cycles)
    if spec.shuffle:
        out = out.withColumn("shuffle_key", M.shuffle_key(F.col(key), seed, F.col("epoch") if cycles else 0))
    if batch_size:
        order = ["shuffle_key"] if spec.shuffle else [key]
        from loomwright.operators.assemble import instance_ids

        out = M.batch(instance_ids(out, *order, key), F.col("instance_id").cast("long"), batch_size)
    return out


def build_many(parts: dict[str, DataFrame], mode: str = "concat", weights: list[float] | None = None, order: str = "key") -> DataFrame:
    """Pipelines' results mixed, over the columns that all have."""
    common = [c for c in next(iter(parts.values())).columns if all(c in d.columns for d in parts.values())]
    return M.mix({n: d.select(*common) for n, d in parts.items()}, mode, weights, order)


def with_options(name: str, **options) -> Pipeline:
    spec = REGISTRY.get("pipeline", name)
    return replace(spec, options={**spec.options, **options})
