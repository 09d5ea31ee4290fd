"""The queries of this subpackage and their SQL, by name."""

from loomwork.llm import audio, chat, decontaminate, lm, mixing, near, personal, repeats, token_counts, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_join_near_texts": near.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_format_chats": chat.op4,
    "op5_personal_data": personal.op5,
    "op6_score_language": lm.op6,
    "op7_align_audio": audio.op7,
    "op8_remove_repeats": repeats.op8,
    "op9_count_tokens": token_counts.op9,
    "op10_toxicity": toxicity.op10,
}
#: The others are not expressible in SQL; tests hold them against brute force.
SQL = {"op1_mix_sources": mixing.OP1_SQL, "op4_format_chats": chat.OP4_SQL}
