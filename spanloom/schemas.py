"""Row shapes of the engine's tables."""

WORD = "struct<start:double,end:double,text:string,prob:double>"
SENTENCE = f"struct<idx:int,start:double,end:double,text:string,pause_before:double,pause_after:double,n_words:int>"
SEGMENTS = f"transcript_id string, language string, duration double, seg_idx int, start double, end double, text string, words array<{WORD}>, no_speech_prob double, avg_logprob double"
CLIP = "transcript_id string, rank int, start_idx int, end_idx int, start double, end double, heuristic double, overall double, confidence double, clip_type string, source string, merged_from int, hook double, payoff double, emotion double, curiosity double, standalone double, editability double"
