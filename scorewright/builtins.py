"""Names of the built-in scorers, extractors and reports, for lookup by benchmark rules."""

from __future__ import annotations

from scorewright.functions import extract, score
from scorewright.operators import reports
from scorewright.registry import register_extractor, register_pandas_scorer, register_report, register_scorer

COLUMN_SCORERS = (
    "exact contains_answer consensus vqa_consensus default_vqa edit_ratio anls relaxed_number close_number typed_score numeric_equal word_match "
    "reciprocal_rank aligned_list_accuracy token_f1 jaccard set_equality set_precision sequence_equality prefix_ratio sequence_accuracy dict_equality "
    "dict_key_recall dict_precision exact_string simple_string near_string multi_reference positive_int relative_difference mean_square normalised_rmse "
    "general_number geo_proximity coordinate_sequence array_box_iou boxes_mean_iou interval_array_iou single_interval_iou graded_count_score "
    "single_option_match first_char_or_phrase option_pair_match choice_or_line_match category_equal closeness table_lists_equal typed_equal "
    "line_edit_similarity reading_order_error document_similarity true_false_fact damerau_similarity list_edit_distance"
).split()
PANDAS_SCORERS = "matcher_ratio lcs_length".split()
EXTRACTORS = (
    "infer_option infer_option_by_text infer infer_sequence infer_by_type first_letter yes_no first_of leading_yes_no true_false choice_by_rule match_caption_option "
    "last_answer_tag tagged_option ans_tag last_braces first_capital fenced_json fenced_choice_score fenced_intervals fenced_open_result numbers single_number count_0_20 "
    "parse_box parse_point rating_lines component_fractions pairwise_verdict clock_to_seconds options_from_question clean_split_answer correct_phrase judged_answer "
    "direct_scores right_wrong summary_true_false score_dictionary quote_fix answer_field drop_additional_text literal_list literal_set literal_dict literal_boxes literal_points"
).split()
REPORTS = (
    "accuracy_report two_level_report pivot_report task_tree_report vqa_report default_rating binary_f1_report category_remap_rating sum_of_categories "
    "confusion_report hit_rate_report multi_label_report positive_f1 all_vs_valid duration_cube bucketed_report grounding_report type_rating "
    "success_total_rollup macro_over_sources macro_and_micro grouped_super_means cycle_report score_sum_report relative_score win_rate_reward "
    "mean_relative_accuracy level_report field_weighted_score attribute_breakdown nan_safe_mean case_report count_histogram mode_of_group "
    "radar_normalise running_mean step_precision_recall staged_judgement combined_label_report companion_score"
).split()


def register_builtins() -> None:
    for name in COLUMN_SCORERS:
        register_scorer(name, getattr(score, name))
    for name in PANDAS_SCORERS:
        register_pandas_scorer(name, getattr(score, name))
    register_pandas_scorer("json_objects", extract.json_objects)
    for name in EXTRACTORS:
        register_extractor(name, getattr(extract, name))
    for name in REPORTS:
        register_report(name, getattr(reports, name))
