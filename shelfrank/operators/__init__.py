"""DataFrame -> DataFrame operators (lazy; no session creation, no driver loops).

labels    B1–B11  labels, product texts, cleaning filters, keyword flags
dedup     C1–C3   unique products, distinct values
sampling  C5–C8   seeded global rank, exact samples, first/seeded groups
splits    C4, E1, E2  query-level splits
encode    F1, F2, F5, A10  hashing and batch encoders, embedding cache
ranking   E3, F3, G1, G4–G6  scoring and ranking (window and skew-proof sorted forms)
search    E4, G2, G3, A11  blocked exact catalog top-k, blocklists, text reports
metrics   H1–H6, D8, D12, A7  ranking metrics and summaries
profile   C3, D1–D11, D13  dataset profiling
training  I1–I3   training pairs, batches, run plan
compare   E5, E6, J1, J2  leaderboard
judge     E7, K1–K6  prompts, pluggable judge, verdict parsing
"""
