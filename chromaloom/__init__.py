"""chromaloom: a Spark-native engine for chromatin-contact and multi-omics tables."""
