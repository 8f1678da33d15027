"""Training-data pipeline operators: one module per operator, ``queries`` for their registered forms.

Nothing outside this package imports it.
"""
