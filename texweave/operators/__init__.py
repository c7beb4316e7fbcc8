"""DataFrame operators: filters, profiles, sampling, sequences, joins, subwords, evaluation."""
