"""Fieldwork analytics on Spark: contact histories, response propensity,
case targeting and representativeness indicators as DataFrame operators."""
