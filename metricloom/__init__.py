"""Model-monitoring metrics as Spark DataFrame jobs.

Inference tables go in; bucketed metric series, a versioned long metric table,
dashboard series, alert states and audit rows come out.
"""
