"""Code-coverage analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and works on all waypoints
(project, commit) at once. See README.md for the layout.
"""
