"""Queries of this subpackage and their SQL twins, for the entry module."""

from __future__ import annotations

from monthloom.llm import (
    centroids,
    chat,
    decontaminate,
    hard_negatives,
    language_id,
    language_model,
    line_dedup,
    ngram_join,
    packing,
    page_text,
    pii,
    quality,
    url_filter,
)

QUERIES = {
    "op8_preference_chat": chat.op8_preference_chat,
    "op5_suffix_line_dedup": line_dedup.op5_suffix_line_dedup,
    "op9_path_template_filter": url_filter.op9_path_template_filter,
    "op2_personal_data": pii.op2_personal_data,
    "op1_divergence_quality": quality.op1_divergence_quality,
    "op4_segmentation_language_id": language_id.op4_segmentation_language_id,
    "op10_deleted_interpolation": language_model.op10_deleted_interpolation,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_winnowing_decontamination": decontaminate.op7_winnowing_decontamination,
    "op11_bit_plane_clusters": centroids.op11_bit_plane_clusters,
    "op12_recurrent_page_text": page_text.op12_recurrent_page_text,
    "op13_hyperplane_tree_negatives": hard_negatives.op13_hyperplane_tree_negatives,
}

ORACLES = {
    "op8_preference_chat": chat.ORACLE,
    "op3_ngram_jaccard_join": ngram_join.ORACLE,
    "op7_winnowing_decontamination": decontaminate.ORACLE,
    "op11_bit_plane_clusters": centroids.ORACLE,
    "op13_hyperplane_tree_negatives": hard_negatives.ORACLE,
}
