"""tabulon: DataFrame operators for labelled document, record and typed-graph corpora on Spark."""
