"""Annotation datasets as projections: what each kind of sample takes from an annotation record, and the named datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import base_name_id, caption_clean, question_clean
from loomwright.operators.assemble import NLVR_CLASSES, SNLI_CLASSES, class_index, dense_ids, instance_ids
from loomwright.operators.metrics import answer_weights
from loomwright.plans.registry import REGISTRY

Kind = dict[str, Column | Callable[[], Column]]


def _weights(answers: Column) -> dict[str, Column]:
    w = answer_weights(answers)
    return {"answers": F.transform(w, lambda x: x["answer"]), "weights": F.transform(w, lambda x: x["weight"])}


def _c(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


#: What a sample has, by kind; media columns stay paths. Text goes through the caption or the question cleaning.
KINDS: dict[str, Callable[[], dict[str, Column]]] = {
    "caption": lambda: _c("image", "image_id") | {"text_input": caption_clean(F.col("caption"))},
    "caption_eval": lambda: _c("image", "image_id", "instance_id"),
    "coco_caption_eval": lambda: _c("image", "instance_id") | {"image_id": base_name_id(F.col("image"))},
    "nocaps_eval": lambda: _c("image", "instance_id") | {"image_id": F.col("img_id")},
    "web_pair": lambda: _c("image") | {"caption": caption_clean(F.col("caption")), "type": F.lit("image_text")},
    "web_plain": lambda: _c("image") | {"text_input": F.col("caption")},
    "pair": lambda: _c("image") | {"caption": caption_clean(F.col("caption"))},
    "pair_text": lambda: _c("image") | {"text_input": caption_clean(F.col("caption")), "text_output": F.col("caption")},
    "video_caption": lambda: _c("video", "image_id") | {"text_input": caption_clean(F.col("caption"))},
    "video_caption_eval": lambda: _c("video", "image_id", "instance_id"),
    "vqa": lambda: _c("image") | {"text_input": question_clean(F.col("question"))} | _weights(F.col("answer")),
    "vqa_eval": lambda: _c("image", "question_id", "instance_id") | {"text_input": question_clean(F.col("question"))},
    "direct_vqa": lambda: _c("image") | {"text_input": question_clean(F.col("question"))} | _weights(F.col("direct_answers")),
    "direct_vqa_eval": lambda: _c("image", "question_id", "instance_id", "choices", "correct_choice_idx", "direct_answers") | {"text_input": question_clean(F.col("question"))},
    "one_answer": lambda: _c("image") | {"text_input": question_clean(F.col("question")), "answers": F.array("answer"), "weights": F.array(F.lit(1.0))},
    "one_answer_low": lambda: _c("image") | {"text_input": question_clean(F.col("question")), "answers": F.array("answer"), "weights": F.array(F.lit(0.2))},
    "one_answer_eval": lambda: _c("image", "answer", "question_id", "instance_id") | {"text_input": question_clean(F.col("question"))},
    "pair_class": lambda: _c("instance_id") | {"image0": F.col("images")[0], "image1": F.col("images")[1], "text_input": caption_clean(F.col("sentence")), "label": class_index(F.col("label"), NLVR_CLASSES)},
    "entailment": lambda: _c("image", "instance_id") | {"image_id": F.col("image"), "text_input": caption_clean(F.col("sentence")), "label": class_index(F.col("label"), SNLI_CLASSES)},
    "retrieval": lambda: _c("image", "image_id", "instance_id") | {"text_input": caption_clean(F.col("caption"))},
    "retrieval_eval": lambda: _c("image", "caption") | {"index": F.col("instance_id"), "path": F.col("image")},
    "video_retrieval": lambda: _c("video", "image_id") | {"text_input": caption_clean(F.col("caption"))},
    "video_retrieval_eval": lambda: _c("video") | {"index": F.col("instance_id")},
    "video_qa": lambda: _c("video", "question_id", "instance_id") | {"text_input": question_clean(F.col("question")), "answers": F.col("answer")},
    "dialogue": lambda: _c("image_id", "instance_id", "dialog"),
    "image_folder": lambda: _c("image", "label", "image_id", "instance_id") | {"file": F.col("image")},
    "plain": lambda: {},
}

#: Named datasets: the kind of training samples, and of evaluation samples.
DATASETS: dict[str, tuple[str | None, str | None]] = {
    "coco_caption": ("caption", "coco_caption_eval"),
    "nocaps": (None, "nocaps_eval"),
    "msrvtt_caption": ("video_caption", "video_caption_eval"),
    "msvd_caption": ("video_caption", "video_caption_eval"),
    "vatex_caption": ("video_caption", "video_caption_eval"),
    "nlvr": ("pair_class", "pair_class"),
    "snli_ve": ("entailment", "entailment"),
    "avsd_dialogue": ("dialogue", "dialogue"),
    "coco_llava": ("pair", None),
    "coco_pair": ("pair", None),
    "coco_brush": ("pair_text", None),
    "conceptual_caption_3m": ("pair", None),
    "conceptual_caption_12m": ("pair", None),
    "conceptual_caption_3m_web": ("web_pair", None),
    "conceptual_caption_12m_web": ("web_pair", None),
    "sbu_caption": ("pair", None),
    "vg_caption": ("pair", None),
    "laion2B_multi": ("web_plain", None),
    "laion400M_multi": ("web_pair", None),
    "laion_coco_600M": ("web_pair", None),
    "MMC4": ("web_pair", None),
    "datacomp_small": ("web_pair", None),
    "imagenet": ("image_folder", "image_folder"),
    "msrvtt_retrieval": ("video_retrieval", "video_retrieval_eval"),
    "didemo_retrieval": ("video_retrieval", "video_retrieval_eval"),
    "coco_retrieval": ("retrieval", "retrieval_eval"),
    "flickr30k": ("retrieval", "retrieval_eval"),
    "msrvtt_qa": ("video_qa", "video_qa"),
    "msvd_qa": ("video_qa", "video_qa"),
    "coco_vqa": ("vqa", "vqa_eval"),
    "vg_vqa": ("one_answer_low", None),
    "ok_vqa": ("vqa", "vqa_eval"),
    "aok_vqa": ("direct_vqa", "direct_vqa_eval"),
    "gqa": ("one_answer", "one_answer_eval"),
}
for _name, _kinds in DATASETS.items():
    REGISTRY.add("dataset", _name, _kinds)

SPLITS = ("train", "val", "test")


def load(name: str, annotations: DataFrame, order: str, split: str = "train") -> DataFrame:
    """The named dataset's samples from its annotations: instance ids in order, image ids by first appearance where a kind
    numbers them, then the projection. Other splits than train, val and test are refused. Annotations that have an instance_id keep
    it, so that a table of which many datasets are made is numbered once; kinds without one number nothing."""
    if split not in SPLITS:
        raise ValueError(split)
    kind = REGISTRY.get("dataset", name)[0 if split == "train" else 1]
    if kind is None:
        raise ValueError(f"{name} has no samples for {split}")
    cols = KINDS[kind]()
    numbered = "instance_id" in annotations.columns or cols and "instance_id" not in "".join(str(c) for c in cols.values())
    df = annotations if numbered else instance_ids(annotations, order)
    if "image_id" not in df.columns and kind in ("caption", "retrieval", "video_caption", "video_retrieval"):
        df = dense_ids(df, "video" if kind.startswith("video") else "image", order, "image_id")
    return df.select(*[c.alias(n) for n, c in cols.items()]) if cols else df
