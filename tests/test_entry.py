import __spark_entry__ as entry

PLANNED = """
latest_batch_snapshot latest_batch_value append_then_latest overwrite_roundtrip batch_stamp_union batch_restamp
feed_top_n_per_topic topic_counts is_new_flag dense_row_id feed_term_filter dedup_url_topic duplicate_keys_having
embeddable_rows limit_or_all row_lookup article_text combined_text doc_title category_parse category_parse_parity
category_membership dedup_url feed_scan timestamp_parse enrich_merge model_reply_parse enrich_success_rate
sentiment_badge keywords_render embedding_merge knn_self_join l2_normalize embedding_json_roundtrip near_dup_edges
duplicate_count duplicate_count_histogram greedy_dedup topic_relevance importance_rank frequency_rank rrf_score
rrf_rank topic_union top15_with_ties topic_partitioned_write ui_projection export_ui_and_full highlights_head5
highlights_markdown chunk_sliding chunk_metadata idf_table index_build_counts index_run_metrics chunk_sentences
chunk_dense_dims batch_model_callback sparse_retrieve_topk hybrid_rrf context_json prompt_assemble question_rephrase
dense_retrieve_topk dense_retrieve_filtered interaction_count chat_history intent_parse intent_gate
""".split()


def test_every_planned_query_is_registered_with_sql():
    assert set(PLANNED) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # the training-data operators (op..., pipeline) bring SQL only where SQL can express them
    own = {n for n in entry.queries() if n != "pipeline" and not n.startswith("op")}
    assert own <= set(entry.oracle_sql())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "rrf_rank" in df.columns
