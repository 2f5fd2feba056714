"""Run-telemetry and frame-scoring analytics as Spark jobs.

Every public function takes DataFrames and returns DataFrames (or writes one).
The run id ``pid`` is a column everywhere, so one plan serves any number of runs.
"""
