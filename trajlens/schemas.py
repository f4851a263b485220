"""Explicit schemas of the log tables; missing JSON fields read as NULL."""

STEP = (
    "struct<step_index:int,action:string,candidates_before:array<string>,candidates:array<string>,"
    "gold_action:string,valid:boolean,reward:double,done:boolean,selected_score:double,"
    "controller_reasons:array<string>,gold_in_candidates:boolean,gold_rank_before:int,gold_rank_after:int,"
    "selected_is_gold:boolean,top1_action:string,"
    "top1_structural_reasons:array<string>,top1_structural_bad:boolean,"
    "reranker_used:boolean,reranker_abstained:boolean,reranker_intervened:boolean,reranker_margin:double,"
    "reranker_safety_reason:string>"
)
TRAJECTORY_FIELDS = (
    "task_id:string,trajectory_id:string,seed:bigint,rollout_seed:bigint,game_seed:bigint,game_id:string,"
    "env:string,difficulty:string,config_id:string,success:boolean,error:string,total_reward:double,"
    f"metrics:map<string,double>,steps:array<{STEP}>"
)
EDIT = (
    "struct<edit_type:string,index:int,action:string,labels:array<string>,edited_actions:array<string>,"
    "valid:boolean,success:boolean,total_reward:double,final_equivalent_to_original:boolean,replacement:string,"
    "repair_suffix:array<string>,second_index:int,second_action:string>"
)
SUMMARY = "struct<index:int,action:string,labels:array<string>,repair_replacements:array<string>>"
REPORT_FIELDS = (
    "task_id:string,seed:bigint,original_actions:array<string>,original_success:boolean,replay_success:boolean,"
    f"replay_valid:boolean,total_reward:double,action_summaries:array<{SUMMARY}>,edits:array<{EDIT}>,"
    "metrics:map<string,double>"
)
PREFERENCE_FIELDS = (
    "task_id string, trajectory_id string, seed bigint, step_index int, history array<string>, candidates array<string>,"
    "preferred_action string, rejected_action string, certificate_level string, repair_suffix_len int,"
    "preferred_rank_before int, rejected_rank_before int, source string, original_outcome string, game_seed bigint,"
    "game_id string, config_id string, difficulty string, initial_observation string, observation string"
)
PREDICTION_FIELDS = (
    "task_id string, seed bigint, step_index int, history array<string>, ranked_actions array<string>, scores string,"
    "candidate_scores string, abstain boolean, abstained boolean, margin_over_raw_top1 double"
)
