"""All queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from gatewarden.plans import oracles
from gatewarden.plans import queries as q

NAMES = (
    "structure_identifier_counts param_values_by_structure unknown_structure_split msu_parts msu_parts_whole_path word_tokens_freq "
    "token_class_counts vocab_topk_ids sequence_encode_pad sequence_counts_dedup value_shape_counts label_histogram methods_rollup "
    "merge_vocab_union embedding_merge_antijoin knn_top6 knn_vote confusion_matrix classification_report binary_accuracy "
    "attack_label_extract final_answer_extract prompt_split length_histogram length_totals error_rate_tumbling error_rate_10s "
    "adaptive_bucket dedup_keep_last row_hash_dedup attack_type_topk totals paged_search retention_7d props_json_extract status_router "
    "request_lines url_split url_word_tokens similar_pairs cluster_assign cluster_size_histogram signature_rules containment_bucket "
    "hmm_anomaly_verdict stage_resume two_stage_classification stream_vs_batch_counts latest_event "
    "request_heads canonical_urls body_kinds vocabulary_by_class placeholder_sequences sequence_words first_pairs json_identifiers "
    "json_parameters shape_code_lists character_counts clean_texts filled_prompts escaped_patterns signature_patterns aligned_characters "
    "aligned_words parts_with_headers custom_bodies identifier_codec event_lags union_rate positional_join reportable_labels "
    "clusters_without_outlier cluster_medoids rule_fields list_merge "
    "direct_classification one_stage_classification realtime_attacks chat_prompts message_inputs turn_tokens abnormal_rows task_clusters "
    "detection_counters least_lag outgoing_messages time_stamps rate_axis unescaped_texts unquoted_urls"
).split()


def queries() -> dict:
    return {name: getattr(q, name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: oracles.SQL[name] for name in NAMES if name in oracles.SQL}
