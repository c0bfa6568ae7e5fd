"""Fixed values the text and scoring rules work with: word lists, aliases and patterns."""

from __future__ import annotations

# Reasoning structure spellings
REASONING_ALIASES = {
    "conflict_resolution": "conflict-resolution", "trajectory_based": "trajectory-based", "single_hop": "single-hop", "multi_hop": "multi-hop",
    "aggregation": "multi-hop", "cross-session": "multi-hop", "causal-chain": "multi-hop", "contrastive": "conflict-resolution", "contrast": "conflict-resolution",
}
REASONING = ["direct", "single-hop", "multi-hop", "conflict-resolution", "trajectory-based"]

# Enum spellings after lower-casing and separators to spaces; others keep their words joined by _
QUESTION_TYPE_ALIASES = {"judgement": "judgment"}
MODALITY_MARKED = ["voice_style_removed", "text_removed", "modality_ambiguous", "voice_style_ambiguous", "text_ambiguous"]

# Words that are no emotions
NON_EMOTION_TERMS = ["politeness", "self_minimization", "validation", "directness", "humor", "joking", "withdrawal", "people_pleasing"]

# Spellings of measurable points
MEASURABLE_POINTS = {
    "conflict_resolution": "conflict resolution", "trajectory_based_relation_change": "trajectory-based relation change", "semi_explicit_emotion": "semi-explicit emotion",
    "long_term_implicit_emotion": "long-term implicit emotion", "long_term_fact": "long-term fact", "near_term_fact": "near-term fact",
}

# References to sessions or turns that a question text must not make
FORBIDDEN_REFERENCE = r"(?i)\bsession\s+\d+\b|\bs\d+\b|\bd\d+:\d+\b"

# Words by which a description of a voice gives away the hidden state
LEAK_RULES = {
    "emotion_distress": "anxious|anxiety|apprehensive|nervous|worried|stressed|overwhelmed",
    "emotion_negative": "frustrated|frustration|defensive|disappointed|disappointment|ashamed|shame",
    "emotion_positive": "relieved|relief|grateful|gratitude|content|confident|hopeful|hurt",
    "emotion_other": "angry|anger|sad|fearful|afraid|resentful|embarrassed",
    "interpretive_verb": "masking|showing|revealing|indicating|suggesting|signifying|reflecting",
    "hidden_state_reference": "feeling|feels|emotion|emotional|underlying",
}

# Damaged characters and what they stood for, in this order
MOJIBAKE = [("鈥?", "'"), ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("Â ", " "), ("Â", "")]

# Marks of a turn that sums up or closes
LATE_SUMMARY = ["thank you", "thanks again", "appreciate", "grateful", "empowering", "better equipped", "clear sense of direction", "clearer framework",
                "much more manageable", "really helped", "more confident", "less anxious", "true partnership", "huge difference",
                "see you", "goodbye", "next week", "talk next week"]

# Marks of outcome language
OUTCOME = ["less anxious", "more confident", "better equipped", "clear sense of direction", "clear path forward", "clearer framework", "huge difference",
           "made a real difference", "true partnership", "manage it better", "trying to manage it better", "evolved by this turn", "overall demeanor",
           "proactive request", "group charter", "less like... hoping for the best", "less like hoping for the best", "weight has been lifted", "feel lighter",
           "it's okay not to be fine", "okay not to be 'fine'", "cautiously trusting", "emotional growth", "profound positive shift", "newfound coping",
           "newfound self-efficacy", "grew", "growth at this point", "impact of her conversation", "glad we talked", "stable", "managing", "much better",
           "work in progress", "relationship with", "reveals about her emotional state and growth"]

# Marks of residual tension, growth talk and generic wording in late questions
RESIDUAL = ["lingering", "still worry", "not wanting to end up", "hoping for the best", "actual approach before", "before this conversation"]
GROWTH = ["relationship with", "emotional growth", "growth at this point", "overall demeanor", "proactive request", "cautiously trusting", "manage it better"]
GENERIC_LATE = ["what does this reveal about her relationship", "overall demeanor and proactive request", "how has her approach evolved"]
GENERIC_JUDGMENT = ["what does this signify", "what does this indicate", "what does this reveal about", "emotional state and growth", "evolution of their relationship", "long-term growth"]
SURFACE_CLOSURE = ["manageable", "helped", "fine", "back to normal", "work out", "clearer framework"]
CLOSURE = ["goodbye", "see you", "see you next week", "thank you again", "casual goodbye", "relaxed goodbye", "final goodbye", "closing", "sign-off", "signoff"]

# Short names of modality conditions
MODALITY_SHORT = {"normal": "normal", "voice_style_missing": "missing", "voice_style_removed": "missing", "modality_missing": "missing",
                  "voice_style_ambiguous": "low_quality", "modality_ambiguous": "low_quality", "text_ambiguous": "low_quality", "text_removed": "missing"}

# Weights of the judge's partial scores
JUDGE_WEIGHTS = {"core_answer_correct": 0.35, "key_point_coverage": 0.30, "rationale_alignment": 0.20, "unsupported_claims": 0.10, "insufficiency_handling": 0.05}

# Wording for voice descriptions, whole words in any case, in this order
VOICE_REWORDING = [
    ("a hint of relief", "small exhale before the next phrase"),
    ("a sense of relief and acceptance", "small exhale, softer closing words"),
    ("a sense of relief", "small exhale"),
    ("a clear expression of increased confidence", "steadier pace and firmer articulation"),
    ("genuine gratitude", "warmer tone, softer closing words"),
    ("deep gratitude", "warmer tone, softer closing words"),
    ("heartfelt gratitude", "warmer tone, softer closing words"),
    ("sincere", "steady, softened delivery"),
    ("grateful", "warmer, softer closing words"),
    ("gratitude", "warmer, softer closing words"),
    ("relief", "small exhale"),
    ("defensive", "firmer, clipped delivery"),
    ("frustrated", "tighter delivery, faster pace"),
    ("frustration", "tighter delivery"),
    ("ashamed", "quieter delivery, clipped ending"),
    ("shame", "quieter delivery"),
    ("anxious", "quicker pace, tighter delivery"),
    ("anxiety", "quicker pace, tighter delivery"),
    ("concerned", "slower onset, lower pitch"),
    ("nervous", "quicker pace, slightly tight delivery"),
    ("vulnerable", "quieter, less guarded delivery"),
    ("emotional", "audibly strained"),
    ("thoughtful", "brief pause before speaking"),
    ("reflecting", "looking back"),
    ("indicating", "marked by"),
    ("suggesting", "introducing"),
    ("explaining", "spelling out"),
    ("expressing", "with"),
    ("admitting", "saying"),
    ("acceptance", "more settled pacing"),
    ("optimistic", "slightly lighter pace"),
    ("hopeful", "slightly lighter pace"),
    ("content", "more settled pacing"),
    ("observing", "measured, slightly quieter"),
    ("finality", "cleaner sentence ending"),
    ("overwhelmed", "under pressure"),
    ("more emotion", "more audible strain"),
    ("emotion", "audible strain"),
    ("feeling", ""),
    ("relieved but still focused on", "small exhale before mentioning"),
    ("relieved", "small exhale before the next phrase"),
    ("appreciative", "softer volume, slower closing words"),
    ("patient", "steady pace, unhurried delivery"),
    ("attentive", "steady pacing, brief pauses"),
    ("curious", "brief pause before speaking"),
    ("curiosity", "extra emphasis on key terms"),
    ("engaged", "steadier pace, more emphasis on key terms"),
    ("open", "unhurried onset"),
    ("acknowledging", "brief pause before the next clause"),
    ("affirming", "softer volume, slightly brighter cadence"),
    ("inviting", "rising intonation at the end"),
    ("professional", "even, controlled"),
    ("calm", "even pace, lower volume"),
    ("supportive", "softened volume, steadier pace"),
    ("reassuring", "slower onset, softer volume"),
    ("offering practical help", "structured, step-by-step cadence"),
    ("focused on minute details", "extra emphasis on small technical words"),
    ("focused on", "extra emphasis on"),
    ("slightly brighter cadence tone", "slightly brighter cadence"),
    ("slightly tense", "slightly tight delivery"),
    ("practical help", "step-by-step guidance"),
    ("instructional", "structured cadence"),
    ("encouraging", "slightly brighter cadence"),
    ("a hint of underlying tension", "slightly tight delivery"),
    ("underlying tension", "slightly tight delivery"),
    ("suggesting a strategy", "structured, directive cadence"),
    ("suggesting refinement", "measured, evaluative cadence"),
    ("admitting to feeling overwhelmed", "longer pause before the final phrase"),
    ("validating", "gentle, slower-paced"),
    ("reflective", "measured pacing"),
    ("showing understanding", "softened volume, brief pauses"),
    ("showing profound understanding", "softened volume, steady pacing"),
    ("showing genuine intellectual curiosity", "steadier pace, more emphasis on analytical terms"),
    ("showing initiative", "firmer articulation"),
    ("showing active problem-solving", "structured, step-by-step cadence"),
    ("showing clear rationale and agency", "clearer emphasis on the final phrase"),
    ("showing managed self-doubt", "slight pause before the final phrase"),
    ("showing agency", "firmer articulation"),
    ("showing genuine", "with"),
    ("more confident", "steadier pace"),
    ("confident", "steady, firmer articulation"),
    ("self-assured", "steady, firmer articulation"),
    ("indicating new perspective", "slight upward inflection at the end"),
    ("cautious relief", "small exhale before the final words"),
    ("empathetic", "gentle, softened delivery"),
    ("prioritizing emotional check-in", "slower opening, gentle pacing"),
    ("acknowledging the difficulty", "slower onset, brief pause before the next clause"),
    ("revealing his underlying fear of failure and wasting time", "voice tightens slightly, longer pause before the final clause"),
    ("summarizing his emotional state", "measured recap cadence"),
    ("revealing lingering anxiety and guardedness", "hesitant start, clipped ending"),
    ("emphasizing the emotional impact", "softer volume on the final phrase"),
    ("revealing deeper fear", "voice turns quieter mid-sentence"),
    ("validating his internal experience", "softened volume, deliberate pacing"),
    ("expressing vulnerability and shame", "quieter delivery, trailing final words"),
    ("accepting the challenge with a new mindset", "steadier pace, cleaner sentence endings"),
    ("a clear sense of relief and gratitude", "lighter pace, softer ending"),
    ("analytical", "precise articulation"),
    ("slightly academic", "more formal wording"),
    ("slightly abstract", "slower onset"),
    ("slightly dismissive", "flatter ending, clipped delivery"),
    ("dismissive", "flatter ending"),
    ("focused", "firmer articulation on key words"),
    ("determined", "firmer articulation"),
    ("weariness", "longer pause before the final phrase"),
    ("weary", "slower onset"),
    ("fatigue", "slower pace"),
    ("strain", "slightly tight delivery"),
    ("stressed", "slightly tight delivery"),
    ("stress", "tighter delivery"),
    ("concern", "slower onset"),
    ("underlying concern", "slower onset on the last phrase"),
    ("underlying weariness", "longer pause before the final phrase"),
    ("audibly strained content", "tighter delivery on the final phrase"),
    ("audibly strained", "tighter delivery"),
    ("underlying", ""),
    ("undertone of", ""),
    ("seeking reassurance", "rising intonation at the end"),
    ("seeking tone", "rising intonation at the end"),
    ("when minimizing", "as the final words soften"),
    ("minimizing", "softening the final words"),
    ("masked by", "followed by"),
    ("note of", ""),
    ("sense of appreciation for his effort", "softer volume, slower closing words"),
    ("forward-looking", "cleaner sentence ending"),
    ("objective", "even, clipped"),
]

# Fallback wording for leaking voice descriptions, in this order
VOICE_FALLBACK = [
    (r"\b(anxious|anxiety|apprehensive|nervous|worried|stressed|overwhelmed)\b", "slightly tight delivery"),
    (r"\b(frustrated|frustration|defensive|disappointed|disappointment)\b", "firmer, clipped delivery"),
    (r"\b(ashamed|shame|embarrassed)\b", "quieter delivery"),
    (r"\b(relieved|relief|grateful|gratitude|content|hopeful)\b", "softer closing words"),
    (r"\b(confident|self-assured)\b", "firmer articulation"),
    (r"\b(angry|anger|sad|fearful|afraid|resentful|hurt)\b", "tighter delivery"),
    (r"\b(masking|showing|revealing|indicating|suggesting|signifying|reflecting)\b", ""),
    (r"\b(feeling|feels|emotion|emotional|underlying)\b", ""),
]
