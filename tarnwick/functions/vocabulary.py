"""Fixed values that results depend on: word lists and label tables, as text."""

# Words that do not tell two titles apart.
GENERIC_TITLE_WORDS = (
    "a", "an", "and", "are", "based", "collaborative", "contrastive", "convolution", "cross", "domain", "for", "from",
    "graph", "graphs", "in", "knowledge", "learning", "model", "network", "networks", "neural", "of", "on",
    "recommendation", "recommender", "recommenders", "system", "systems", "session", "sequential", "social", "the", "to",
    "towards", "via", "with",
)

# A paper is on topic if it holds a word of each group.
GRAPH_WORDS = ("graph neural", "graph convolution", "gnn", "gcn", "graph attention", "graph-based recommendation", "graph embedding", "graph learning")
RECOMMENDATION_WORDS = ("recommend", "collaborative filtering", "user-item", "rating prediction", "click-through", "next-item", "session-based", "click prediction")

# Areas by their words, the first that fits.
AREA_WORDS = {
    "knowledge-graph": ("knowledge graph", "knowledge-aware", "kgat", "kgcn", "kgin", "ripplenet"),
    "cross-domain": ("cross-domain", "cross domain", "transfer learning", "domain adaptation", "bitgcf"),
    "session-based": ("session-based", "session based", "next-item", "next item", "sequential recommendation", "sr-gnn", "gc-san"),
    "social": ("social recommendation", "social network", "trust-aware", "diffnet", "graphrec"),
    "contrastive": ("contrastive", "self-supervised", "self supervised", "infonce"),
    "collaborative-filtering": ("collaborative filtering", "matrix factorization", "implicit feedback", "ngcf", "lightgcn"),
}

# The searches that a corpus is built from, in the order of balanced selection.
CORPUS_SEARCHES = (
    "graph neural network collaborative filtering",
    "light graph convolution collaborative filtering recommendation",
    "graph contrastive learning for recommendation",
    "self-supervised graph learning recommendation",
    "graph self-supervised recommendation collaborative filtering",
    "cross-domain recommendation with graph neural network",
    "transfer learning cross-domain recommendation graph",
    "cross-domain sequential recommendation graph",
    "knowledge graph enhanced recommendation",
    "knowledge graph neural network recommender systems",
    "knowledge graph collaborative filtering recommendation",
    "multi-behavior recommendation graph neural network",
    "session-based recommendation with graph neural network",
    "sequential recommendation graph neural network",
    "next item recommendation graph neural network",
    "social recommendation with graph neural network",
    "social graph neural network recommendation",
    "social recommendation graph convolution network",
    "federated recommendation graph neural network",
)

# What marks a title as that of a survey.
SURVEY_MARKERS = ("survey", "review", "systematic literature")

# Citation intents by the names that a service and a classifier give them.
SERVICE_INTENTS = {"background": "background", "methodology": "method", "method": "method", "result": "comparison"}
CLASSIFIER_INTENTS = {"background": "background", "method": "method", "result": "comparison", "comparison": "comparison", "label_0": "background", "label_1": "method", "label_2": "comparison"}

# Entity kinds by a recogniser's labels.
ENTITY_KINDS = {"1": "method", "2": "method", "3": "dataset", "4": "dataset", "5": "metric", "6": "metric", "method": "method", "dataset": "dataset", "metric": "metric"}

# Papers that a short name stands for whatever other titles hold it.
TITLE_ANCHORS = {"kgcn": "W2913560138", "fgnn": "W2986515219"}

# Short names by a part of the title key that they stand for.
TITLE_ALIASES = {
    "ngcf": "neural graph collaborative filtering",
    "gcmc": "graph convolutional matrix completion",
    "gc mc": "graph convolutional matrix completion",
    "lrgccf": "revisiting graph based collaborative filtering",
    "lr gccf": "revisiting graph based collaborative filtering",
    "dgcf": "disentangled graph collaborative filtering",
    "ultragcn": "ultragcn",
    "sgl": "self supervised graph learning for recommendation",
    "ncl": "neighborhood enriched contrastive learning",
    "hccf": "hypergraph contrastive collaborative filtering",
    "simgcl": "simple graph contrastive learning",
    "xsim gcl": "extremely simple graph contrastive learning",
    "xsimgcl": "extremely simple graph contrastive learning",
    "lightgcl": "lightgcl simple yet effective graph contrastive learning",
    "dccf": "disentangled contrastive collaborative filtering",
    "kgin": "learning intents behind interactions",
    "kgcn": "kgcn knowledge graph convolutional networks for recommender systems",
    "cke": "collaborative knowledge base embedding",
    "ckan": "collaborative knowledge aware attentive network",
    "kgnnls": "knowledge graph neural networks with label smoothness",
    "kgnn ls": "knowledge graph neural networks with label smoothness",
    "bitgcf": "bi directional transfer graph",
    "bi tgcf": "bi directional transfer graph",
    "ccdr": "contrastive cross domain recommendation",
    "disencdr": "disentangled representations for cross domain recommendation",
    "disen cdr": "disentangled representations for cross domain recommendation",
    "ddtcdr": "deep dual transfer cross domain recommendation",
    "ddt cdr": "deep dual transfer cross domain recommendation",
    "ppgn": "preference propagation graphnet",
    "ptupcdr": "personalized transfer of user preferences for cross domain recommendation",
    "ptup cdr": "personalized transfer of user preferences for cross domain recommendation",
    "gcsan": "graph contextualized self attention",
    "gc san": "graph contextualized self attention",
    "srgnn": "session based recommendation with graph neural",
    "sr gnn": "session based recommendation with graph neural",
    "s3rec": "self supervised learning for sequential recommendation",
    "s3 rec": "self supervised learning for sequential recommendation",
    "cl4srec": "contrastive learning for sequential recommendation",
    "cl4s rec": "contrastive learning for sequential recommendation",
    "tagnn": "target attentive graph neural networks",
    "gc egnn": "global context enhanced graph neural",
    "surge": "sequential recommendation with graph neural networks",
    "fgnn": "rethinking the item order in session based recommendation with graph neural networks",
    "lessr": "handling information loss of graph neural networks",
    "diffnet": "a neural influence diffusion model for social recommendation",
    "mhcn": "multi channel hypergraph convolutional network for social recommendation",
    "graphrec": "graph neural networks for social recommendation",
    "sociallgn": "light graph convolution network for social recommendation",
    "social lgn": "light graph convolution network for social recommendation",
    "diffnet plusplus": "diffnet plusplus",
    "dhcf": "dual channel hypergraph collaborative filtering",
    "hgcn": "hypergraph convolutional network for collaborative filtering",
    "hyperrec": "next item recommendation with sequential hypergraphs",
    "fairgo": "learning fair representations for recommendation a graph based perspective",
    "fairrec": "fairrec",
    "nfcf": "neural fair collaborative filtering",
    "gfair": "gfair",
    "fairgnn": "say no to the discrimination learning fair graph neural networks",
    "metahin": "meta learning on heterogeneous information networks",
    "duorec": "contrastive learning for representation degeneration problem",
    "coserec": "contrastive self supervised sequential recommendation with robust augmentation",
    "iclrec": "intent contrastive learning for sequential recommendation",
    "gfcf": "how powerful is graph convolution for recommendation",
    "pinsage": "graph convolutional neural networks for web scale recommender systems",
    "gcegnn": "global context enhanced graph neural",
    "gce gnn": "global context enhanced graph neural",
    "kcgn": "knowledge aware coupled graph neural",
}
